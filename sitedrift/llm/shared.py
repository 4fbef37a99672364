"""The shared folder and small helpers that several operators use."""

from pyspark.sql import DataFrame

from ..scratch import fresh_folder, partitions, shared_dir, stored

__all__ = ["fresh_folder", "partitions", "shared_dir", "stored", "unused"]


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes to differ from every column of df, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
