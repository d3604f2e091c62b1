"""DataFrame operators: ``op(df, ...) -> DataFrame``."""
