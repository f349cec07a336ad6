"""The query catalogue over the driver tables, each query beside its SQL."""
