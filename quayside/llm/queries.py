"""The operators as registered queries, each over its whole table, with its SQL where SQL can express it."""

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import (
    chat, common, convrepair, cube, filteraudit, idcoder, lattice, oddsketch, phrases, pstable, ranklang, recompress, repeats,
    urlfilter,
)

# Fixed values of the queries' contracts.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
CONTROL_CONVERSATION = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))
END_ID = 1


def vocabulary(name: str) -> str:
    """The text of a public tokenizer's file; tasks get it with their code."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def kept_out(modulus: int) -> str:
    """Condition on ``doc_id``: the document is not held out. A null id counts as the empty text."""
    return f"crc32(coalesce(cast(doc_id as string), '')) % {modulus} <> 2"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_lattice_score(spark: SparkSession, sf: str) -> DataFrame:
    """Word counts, the add-one base score and the lattice score of every document."""
    docs = common.documents(spark, sf).select("doc_id", "text")
    return lattice.score_documents(docs, vocabulary("word_bpe_49k.json"), kept_out(7))


def op2_pstable_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of near-equal vectors within a label."""
    return pstable.near_vectors(table(spark, sf, "embeddings"))


def op3_cube_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return cube.mix(common.documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, urlfilter.RULES)
    judged = urlfilter.judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_range_coded_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place and ids, from the files written."""
    return idcoder.encoded_documents(common.documents(spark, sf), vocabulary("word_bpe_49k.json"), END_ID)


def op6_chat_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every conversation, read back from its windows."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_CONVERSATION, turns.schema)
    return chat.read_back(chat.chat_windows(turns.unionByName(more), vocabulary("byte_bpe_50k.json")))


def op7_odd_sketch_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups on sets of four-word shingles."""
    return oddsketch.near_duplicates(common.documents(spark, sf), size=4, percent=80)


def op8_rank_order_language(spark: SparkSession, sf: str) -> DataFrame:
    """The predicted language of every document."""
    docs = common.documents(spark, sf)
    learned = ranklang.profiles(docs.where(kept_out(4)))
    judged = ranklang.predict(docs.select("doc_id", "text"), learned)
    return judged.select("doc_id", (~F.expr(kept_out(4))).alias("held_out"), "lang_pred", "score")


def op9_phrase_index(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they come from."""
    return phrases.contamination(common.documents(spark, sf), table(spark, sf, "benchmark"))


def op10_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of every document without later copies of 100 bytes."""
    return repeats.without_repeats(common.documents(spark, sf)).drop("kept")


def op11_filter_orders(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes of every language, in all orders of them."""
    return filteraudit.audit(common.documents(spark, sf), table(spark, sf, "labels"))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    return convrepair.repaired(convrepair.damaged(table(spark, sf, "conversations")))


def op13_recompressed_passages(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of every document without passages of 50 words of earlier documents."""
    return recompress.without_earlier_passages(common.documents(spark, sf))


QUERIES = (
    op1_lattice_score, op2_pstable_vectors, op3_cube_mix, op4_url_rules, op5_range_coded_ids, op6_chat_windows,
    op7_odd_sketch_groups, op8_rank_order_language, op9_phrase_index, op10_repeated_passages, op11_filter_orders,
    op12_conversation_repair, op13_recompressed_passages,
)

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH split AS (
    SELECT page_id,
        {LOWERED.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fits AS (
    SELECT DISTINCT s.host, s.path, rule_host || rule_path AS rule, verdict
    FROM split s JOIN rules r
        ON (s.host = rule_host OR ends_with(s.host, '.' || rule_host)) AND starts_with(s.path, rule_path)),
best AS (
    SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM fits GROUP BY host, path)
SELECT page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path
"""

# An item's windows are compared with the document's runs of as many words.
OP9_SQL = f"""
WITH d AS (
    SELECT doc_id,
        list_filter(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
    FROM documents),
b AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
        list_filter(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
    FROM benchmark),
wanted AS (
    SELECT DISTINCT item, n, array_to_string(words[k : k + n - 1], ' ') AS run
    FROM (SELECT item, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k
          FROM b WHERE len(words) > 0)),
places AS (
    SELECT doc_id, n, k, array_to_string(words[k : k + n - 1], ' ') AS run
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k
          FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(words) >= n)),
hits AS (SELECT doc_id, item, k, p.n FROM places p JOIN wanted w ON p.n = w.n AND p.run = w.run),
covered AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
    FROM documents),
sets AS (
    SELECT DISTINCT doc_id, array_to_string(words[k : k + 3], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS k FROM d WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * common >= 80 * (x.n + y.n - common)),
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
    SELECT DISTINCT a, a FROM linked
    UNION
    SELECT b, root FROM reach JOIN linked ON node = a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id,
    coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

OP2_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, root) AS (
    SELECT DISTINCT a, a FROM links
    UNION
    SELECT b, root FROM reach JOIN links ON node = a)
SELECT m.vec_id, coalesce(n, 0) AS n_links, coalesce(root, m.vec_id) AS component_id,
    coalesce(root, m.vec_id) = m.vec_id AS kept
FROM embeddings m
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = m.vec_id
LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = m.vec_id
"""

# Filters by mask; an order is a list of letters, and what a step finds is what no earlier letter removed.
OP11_SQL = """
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
    FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
flags AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(words) < 100)::INT
        + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
        + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT
        + 16 * coalesce(d.doc_id > first, false)::INT AS mask
    FROM d JOIN firsts USING (text) LEFT JOIN flags ON flags.doc_id = d.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
prefixes(prefix, letter, bit, applied) AS (
    SELECT letter, letter, bit, 0 FROM letters
    UNION ALL
    SELECT p.prefix || l.letter, l.letter, l.bit, p.applied + p.bit
    FROM prefixes p JOIN letters l ON ((p.applied + p.bit) & l.bit) = 0),
steps AS (
    SELECT part, prefix, letter,
        coalesce(sum(n) FILTER (mask & (applied + bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & applied <> 0 AND mask & bit <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS toxic_lost
    FROM prefixes, cells GROUP BY part, prefix, letter),
orders AS (
    SELECT o.part, o.prefix AS filter_order, s.*  EXCLUDE (part)
    FROM steps o JOIN steps s ON o.part = s.part AND starts_with(o.prefix, s.prefix) WHERE len(o.prefix) = 5)
SELECT part, filter_order, len(prefix)::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
    redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM orders
"""

# CRC-32 of an ASCII string: a bit at a time, each byte joined with the first of its eight.
CRC32 = """xor(4294967295, list_reduce(
            flatten(list_transform(string_split({}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
            lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295::BIGINT))"""

# What is missing to the end is known from the last row on; then the least letter that stays among the cheapest is taken.
OP12_STATES = ("0", "1", "2", "3")
OP12_NEXT = {"0": "2", "1": "2", "2": "3", "3": "2"}
OP12_KEEP = {"0": "CASE initial WHEN 's' THEN b1 WHEN 'u' THEN b2 END", "1": "CASE initial WHEN 'u' THEN b2 END", "2": "CASE initial WHEN 'a' THEN b3 END", "3": "CASE initial WHEN 'u' THEN b2 END"}


def _op12_sql() -> str:
    consumed = ", ".join(
        f"least(3 + b{s}, CASE WHEN NOT doomed THEN cut + least({OP12_KEEP[s]}, 2 + b{OP12_NEXT[s]}) END) AS c{s}" for s in OP12_STATES
    )
    inserted = ", ".join(f"least(c{s}, 2 + c{OP12_NEXT[s]}, 4 + c{OP12_NEXT[OP12_NEXT[s]]}) AS b{s}" for s in OP12_STATES)
    here = "list_extract([{}], state + 1)"
    costs, after = here.format("a.b0, a.b1, a.b2, a.b3"), here.format("z.b0, z.b1, z.b2, z.b3")
    changed = here.format("z.b2, z.b2, z.b3, z.b2")
    added = here.format("a.b2, a.b2, a.b3, a.b2")
    kept = "CASE WHEN state = 0 AND initial = 's' THEN z.b1 WHEN state <> 2 AND initial = 'u' THEN z.b2 WHEN state = 2 AND initial = 'a' THEN z.b3 END"
    return f"""
WITH RECURSIVE original AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm
    FROM conversations),
rows_left AS (
    SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
        CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE harm WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM original WHERE harm <> 0)),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
    FROM rows_left),
faults AS (
    SELECT *, CASE WHEN said = '' THEN 'blank' WHEN earlier > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS earlier FROM ordered)),
kinds AS (
    SELECT conv_id, i, role, text, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS doomed,
        (coalesce(fault, '') = 'truncated')::INT AS cut FROM faults),
sizes AS (SELECT conv_id, max(i) AS n FROM kinds GROUP BY conv_id),
rest(conv_id, i, b0, b1, b2, b3) AS (
    SELECT conv_id, n + 1, 0, 4, 2, 0 FROM sizes
    UNION ALL
    SELECT conv_id, i, {inserted}
    FROM (SELECT k.conv_id, k.i, {consumed} FROM rest r JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM r.conv_id AND k.i = r.i - 1)),
edits(conv_id, i, state, audit, repaired) AS (
    SELECT conv_id, 1, 0, '', CAST([] AS VARCHAR[]) FROM sizes
    UNION ALL
    SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END,
        CASE WHEN letter = 'D' THEN state WHEN letter = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
        audit || letter,
        CASE letter WHEN 'D' THEN repaired WHEN 'K' THEN list_append(repaired, role || ':' || text)
            ELSE list_append(repaired, CASE state WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END) END
    FROM (
        SELECT e.*, k.role, k.text, k.initial,
            CASE WHEN k.i IS NOT NULL AND 3 + {after} = {costs} THEN 'D'
                WHEN 2 + {added} = {costs} THEN 'I'
                WHEN NOT k.doomed AND k.cut + ({kept}) = {costs} THEN 'K'
                WHEN NOT k.doomed AND k.cut + 2 + {changed} = {costs} THEN 'R' END AS letter
        FROM edits e
        JOIN rest a ON a.conv_id IS NOT DISTINCT FROM e.conv_id AND a.i = e.i
        LEFT JOIN rest z ON z.conv_id IS NOT DISTINCT FROM e.conv_id AND z.i = e.i + 1
        LEFT JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM e.conv_id AND k.i = e.i)
    WHERE letter IS NOT NULL),
done AS (
    SELECT e.conv_id, arg_max(audit, len(audit)) AS audit, arg_max(repaired, len(audit)) AS repaired
    FROM edits e GROUP BY e.conv_id),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b0, 0)::BIGINT AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(repaired, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN rest r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.i = 1
"""


OP12_SQL = _op12_sql()

OP13_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
    FROM documents),
places AS (
    SELECT row, doc_id, k, sha256(array_to_string(words[k : k + 49], ' ')) AS run
    FROM (SELECT row, doc_id, words, unnest(range(1, len(words) - 48)) AS k FROM d WHERE len(words) >= 50)),
firsts AS (SELECT run, min(doc_id) AS first FROM places GROUP BY run HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT row, list(DISTINCT k) AS ks FROM places JOIN firsts USING (run) WHERE doc_id > first GROUP BY row),
gone AS (SELECT row, list(DISTINCT word) AS gone FROM (SELECT row, unnest(range(k, k + 50)) AS word FROM (SELECT row, unnest(ks) AS k FROM starts)) GROUP BY row),
cut AS (
    SELECT row, string_agg(word, ' ' ORDER BY place) AS kept
    FROM (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d) w
    ANTI JOIN (SELECT row, unnest(gone) AS place FROM gone) g ON w.row = g.row AND w.place = g.place
    GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (row) LEFT JOIN cut USING (row)
"""

ORACLES = {
    "op11_filter_orders": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_recompressed_passages": OP13_SQL,
    "op2_pstable_vectors": OP2_SQL,
    "op4_url_rules": OP4_SQL,
    "op7_odd_sketch_groups": OP7_SQL,
    "op9_phrase_index": OP9_SQL,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable of (spark, folder of the tables)."""

    def plain(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(spark, str(sf_dir).rstrip("/"))

        run.__name__, run.__doc__ = query.__name__, query.__doc__
        return run

    return {q.__name__: plain(q) for q in QUERIES}


def oracle() -> dict[str, str]:
    return dict(ORACLES)
