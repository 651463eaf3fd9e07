"""From T-SQL text to a bound plan: lexer, syntax tree, parser."""
