"""The question benchmark: reading it and checking it against its schema."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.functions import text


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold an array of question objects; missing fields are null."""
    return spark.read.schema(schema.QUESTION).json(path, multiLine=True)


def write_questions(questions: DataFrame, path: str) -> None:
    """Questions as files that ``read_questions`` takes, an array of objects in each, one file a partition."""

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [j for b in batches for j in b["j"]]
        yield pd.DataFrame({"value": ["[" + ",\n".join(held) + "]"]})

    questions.select(F.to_json(F.struct(*questions.columns)).alias("j")).mapInPandas(arrays, "value string").write.mode("overwrite").text(path)


def violations(questions: DataFrame) -> DataFrame:
    """(id, field, problem): a row for every required field that is missing and every value outside its enumeration. Gold
    lists may be empty but not null."""
    blank = lambda c: F.col(c).isNull() | (text.strip(F.col(c)) == "")
    checks = [F.when(blank(c), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("problem"))) for c in ("id", "question", "topic", "question_type", "difficulty", "reference_answer")]
    checks += [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("problem"))) for c in ("gold_papers", "gold_chunks")]
    checks += [F.when(~blank(c) & ~F.col(c).isin(*allowed), F.struct(F.lit(c).alias("field"), F.lit("not allowed").alias("problem"))) for c, allowed in (("question_type", schema.QUESTION_TYPES), ("difficulty", schema.DIFFICULTIES))]
    return questions.select("id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("v")).select("id", "v.field", "v.problem")


def profile(questions: DataFrame) -> DataFrame:
    """(topic, difficulty, questions, multi_hop, with_gold) counts."""
    return questions.groupBy("topic", "difficulty").agg(F.count("*").alias("questions"), F.count_if(F.coalesce("requires_multi_hop", F.lit(False))).alias("multi_hop"), F.count_if(F.coalesce(F.size("gold_chunks"), F.lit(0)) > 0).alias("with_gold"))
