"""Review datasets as CSV and parquet: three tables of businesses, users and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.subset import first_reviews

# Columns each reader keeps, when the file has them.
BUSINESS_COLUMNS = ("business_id", "name", "categories", "city", "state", "stars", "review_count")
REVIEW_COLUMNS = ("review_id", "user_id", "business_id", "stars", "date")
USER_COLUMNS = ("user_id", "name", "review_count", "average_stars")
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def number(text: Column | str) -> Column:
    """Text as a number; anything else becomes null."""
    c = F.col(text) if isinstance(text, str) else text
    return c.try_cast("double")


def whole(text: Column | str) -> Column:
    """Text as a whole number, fractions cut off ('4.0' -> 4); anything else becomes null."""
    return number(text).try_cast("int")


def read_text_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV with a header, every column as text.

    The schema is the header line, which is all that is read to plan. Large files are split
    over tasks; ``multi_line`` is for files with line breaks inside quotes, which can't be.
    """
    options = CSV_OPTIONS | {"multiLine": str(multi_line).lower()}
    header = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.options(**options).schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], multi_line: bool = False) -> DataFrame:
    """Known columns of a CSV with a header, all as text."""
    df = read_text_csv(spark, path, multi_line)
    return df.select(*[c for c in columns if c in df.columns])


def read_businesses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_csv(spark, path, BUSINESS_COLUMNS, multi_line)


def read_users(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_csv(spark, path, USER_COLUMNS, multi_line)


def read_reviews(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    df = read_csv(spark, path, REVIEW_COLUMNS, multi_line).withColumnRenamed("stars", "rating")
    return df.withColumn("rating", whole("rating"))


def coerce_numbers(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The listed text columns as doubles, where present; bad values become null."""
    return df.select(*[number(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def catalogue(df: DataFrame) -> DataFrame:
    """(business_id, name, categories) of a business table with loosely spelt column names.

    The name defaults to the id and categories to "N/A" when the column is missing; rows
    without an id are dropped and ids trimmed.
    """
    found = {c.strip().lower(): c for c in df.columns}
    if "business_id" not in found:
        raise ValueError("no business_id column")
    col = lambda name: F.col(f"`{found[name]}`")
    key = col("business_id").cast("string")
    return df.filter(key.isNotNull()).select(
        F.trim(key).alias("business_id"),
        (col("name") if "name" in found else key).alias("name"),
        (col("categories") if "categories" in found else F.lit("N/A")).alias("categories"))


def load_tables(spark: SparkSession, businesses: str, users: str, reviews: str,
                max_users: int = 0, max_reviews: int = 0,
                multi_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables; 0 means no cap. Caps keep the first users by id and the oldest reviews."""
    b, u, r = (read(spark, path, multi_line) for read, path in (
        (read_businesses, businesses), (read_users, users), (read_reviews, reviews)))
    if max_users:
        u = u.orderBy("user_id").limit(max_users)
    return b, u, first_reviews(r, max_reviews)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_dataset(businesses: DataFrame, users: DataFrame, reviews: DataFrame, folder: str) -> None:
    for name, df in (("business", businesses), ("user", users), ("review", reviews)):
        write_csv(df, f"{folder}/{name}")


def csv_to_parquet(spark: SparkSession, source: str, target: str, sizes: list[str],
                   multi_line: bool = False) -> dict[str, str]:
    """Convert the review, user and business CSVs of every size; returns the new folders."""
    out = {}
    for size in sizes:
        for name in ("business", "user", "review"):
            (read_text_csv(spark, f"{source}/{size}/{name}", multi_line)
             .write.mode("overwrite").parquet(f"{target}/{size}/{name}"))
        out[size] = f"{target}/{size}"
    return out
