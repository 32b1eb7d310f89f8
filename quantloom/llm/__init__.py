"""Training-data operators. Nothing outside this subpackage (and the guard in ``__spark_entry__``) imports it."""
