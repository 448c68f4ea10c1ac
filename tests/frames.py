"""Helpers that read results and plans of DataFrames."""


def rows(df):
    """Rows as plain tuples in a stable order."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def plan(df):
    """The executed plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
