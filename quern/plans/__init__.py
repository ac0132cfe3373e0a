"""Text to plan: lexer, parser, binder and the builder of DataFrame plans."""
