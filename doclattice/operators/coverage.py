"""How many symbols of each assembly are documented."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(symbols: DataFrame, documented: DataFrame) -> DataFrame:
    """(asm, documented, total) over all symbol rows; ``documented`` has the column id."""
    marks = documented.select("id").distinct().withColumn("hit", F.lit(1))
    return symbols.select("id", "asm").join(marks, "id", "left").groupBy("asm").agg(F.count("hit").alias("documented"), F.count("*").alias("total"))
