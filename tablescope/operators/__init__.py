"""Operators: lazy DataFrame -> DataFrame functions (profiling, quality, catalog,
lineage, KPIs, marts, dictionary, retail)."""
