"""The strict SQL dialect: text to statements, statements to DataFrames."""
