"""Schema-contract governance as Spark tables: lint, diff, compatibility, history, payloads."""
