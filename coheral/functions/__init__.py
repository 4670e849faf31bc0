"""Column-expression builders.  Everything here returns a pyspark Column and
stays inside whole-stage codegen (no Python UDFs)."""
