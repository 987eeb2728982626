"""Answers of the models: good rows and a reject table, which add up to the input.

An answer is the JSON text of a response (content blocks, of which the text ones
count).  A row whose answer does not hold goes to the rejects with every reason and
the raw text; it is a retry for its stage, never a guess.  Other fields of an answer are
dropped, as a reader that knows nothing of them would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ANSWER, DIAGNOSIS, VERDICTS, Contract
from ..functions.spans import clamp_summary
from ..functions.text import col

_RESPONSE = "content array<struct<type: string, text: string>>"


def answer_text(response) -> Column:
    """The joined text blocks of a response; null where there is none."""
    said = F.filter(F.from_json(col(response), _RESPONSE)["content"], lambda b: (b["type"] == "text") & b["text"].isNotNull())
    return F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda b: b["text"]), ""))


def _judged(responses: DataFrame, contract: Contract) -> DataFrame:
    """responses (id, response) with _text and _problems."""
    rows = responses.withColumn("_text", answer_text("response"))
    none = F.array(F.lit("no text in the response"))
    return rows.withColumn("_problems", F.when(F.col("_text").isNull(), none).otherwise(contract.problems("_text")))


def _rejects(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("_problems") > 0).select("id", F.col("_problems").alias("problems"), F.col("response").alias("raw"))


def classified(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, rejects) of a classifier's responses (id, response).

    answers: id and the fields of an answer, a summary beyond the limit cut; rejects:
    id, problems, raw."""
    rows = _judged(responses, ANSWER)
    value = F.try_parse_json("_text")
    kinds = {"text": "string", "texts": "array<string>"}
    good = rows.where(F.size("_problems") == 0)
    fields = [F.try_variant_get(value, f"$.{f.name}", kinds[f.kind]).alias(f.name) for f in ANSWER.fields]
    return good.select("id", *fields).withColumn("summary", clamp_summary("summary")), _rejects(rows)


def diagnosed(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, summary, cause, fix) and rejects of a diagnoser's responses."""
    rows = _judged(responses, DIAGNOSIS)
    value = F.try_parse_json("_text")
    good = rows.where(F.size("_problems") == 0)
    return good.select("id", *[F.try_variant_get(value, f"$.{f.name}", "string").alias(f.name) for f in DIAGNOSIS.fields]), _rejects(rows)


def adjudicated(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, rejects) of an adjudicator's responses (id, pairs, response), where
    pairs are the pair ids that were asked.

    A response counts whole or not at all: its verdicts must name every pair asked, once,
    and no other, or real merges would be decided by what it left out.  verdicts: id (of
    the pair), same."""
    rows = _judged(responses, VERDICTS)
    said = F.try_variant_get(F.try_parse_json("_text"), "$.verdicts", "array<variant>")
    kind = lambda v, name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit(""))
    sound = F.forall(said, lambda v: (kind(v, "id") == "STRING") & (kind(v, "same") == "BOOLEAN") & (F.coalesce(F.try_variant_get(v, "$.id", "string"), F.lit("")) != ""))
    ids = F.transform(said, lambda v: F.try_variant_get(v, "$.id", "string"))
    asked = F.coalesce("pairs", F.array().cast("array<string>"))
    named = lambda what, pairs: F.when(F.size(pairs) > 0, F.array(F.concat(F.lit(f"{what}: "), F.array_join(pairs, ", "))))
    again = F.array_sort(F.array_distinct(F.filter(ids, lambda x: F.size(F.filter(ids, lambda y: x == y)) > 1)))
    wrong = [named("said twice", again), named("not asked", F.array_sort(F.array_except(ids, asked))), named("not answered", F.array_sort(F.array_except(asked, ids)))]
    none = F.array().cast("array<string>")
    more = F.when(~sound, F.array(F.lit("verdicts: each needs an id and true or false"))).otherwise(F.concat(*[F.coalesce(w, none) for w in wrong]))
    rows = rows.withColumn("_problems", F.when(F.size("_problems") > 0, F.col("_problems")).otherwise(more))
    each = rows.where(F.size("_problems") == 0).select(F.explode(said).alias("v"))
    return each.select(F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.same", "boolean").alias("same")), _rejects(rows)
