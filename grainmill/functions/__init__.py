"""Column functions: each takes and gives Columns, so Catalyst plans and compiles them; no Python runs on executors."""
