"""Column expressions: vectors, quantisation, codecs, losses."""
