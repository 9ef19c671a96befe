"""anamnesis: analytics over large stores of short natural-language facts, on PySpark."""
