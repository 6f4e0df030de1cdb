"""The catalogue of queries: what each one runs, its columns, and the SQL that another engine gets the same rows with."""
