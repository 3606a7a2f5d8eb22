"""Scalar functions: ``names`` and ``xml`` are column expressions, ``markup`` and ``wikitext`` plain Python for Arrow UDFs."""
