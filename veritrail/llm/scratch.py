"""Tables in the shared folder, as the rest of the library makes them, and names that no column has."""

from pyspark.sql import DataFrame

from ..plans.scratch import cut, new_path, shared_folder, table

__all__ = ["cut", "new_path", "shared_folder", "spare", "table"]


def spare(docs: DataFrame, name: str, *others: DataFrame) -> str:
    """``name``, with underscores after it until no column of ``docs`` or the others is called so."""
    taken = {c.lower() for frame in (docs, *others) for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
