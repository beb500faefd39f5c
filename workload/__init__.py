"""The engine's queries over the driver's tables: derived inputs, registered queries, SQL to check them."""
