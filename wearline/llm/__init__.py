"""Training-data operators: extraction, quality, de-duplication, language,
secrets, tokens, mixing and encoding. Nothing else in the library imports
this subpackage."""
