"""The semantic model: logical tables, joins, metrics, time scopes; all of it becomes DataFrame expressions."""
