"""What tests of several modules of the engine need."""


def rows(df, *names):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in (names or df.columns)]).collect()), key=repr)
