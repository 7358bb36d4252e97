"""The query catalogue: each module holds queries over a data folder and, where SQL can say the same, the SQL."""
