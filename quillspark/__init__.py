"""Declarative pipelines over collections of semi-structured records and documents, compiled to Spark DataFrames."""

_FROM_FRAME = ("Frame", "from_dataframe", "read_csv", "read_directory", "read_json", "read_parquet", "read_rows", "settings")


def __getattr__(name: str):
    """The builder is imported when it's first asked for: workers that only unpickle a function needn't load it."""
    if name in _FROM_FRAME:
        from . import frame

        return getattr(frame, name)
    raise AttributeError(name)
