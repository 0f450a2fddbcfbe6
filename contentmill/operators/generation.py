"""Batch generation around injected seams, and the decision on each draft."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentmill.functions.text import filled, first_filled, names_match, fold, quotations_hold, source_reference
from contentmill.operators.draws import round_robin

Seam = Callable[[DataFrame], DataFrame]
#: Writes rows under a name and returns them as written, so that a seam runs once.
Keep = Callable[[DataFrame, str], DataFrame]


class UnknownProduct(ValueError):
    """A product or format that isn't registered."""


@dataclass(frozen=True)
class Product:
    """``formats`` it may have (empty: none at all), the default, and whether quotations are required."""

    name: str
    formats: tuple[str, ...]
    default: str | None
    quotation_required: bool


# The products.
PRODUCTS = {p.name: p for p in (Product("mestre_questoes", ("certo_errado", "abcde"), "certo_errado", True), Product("revisao_farol", (), None, False))}


def product_format(name: str, form: str | None = None) -> tuple[Product, str | None]:
    """The product and the format to use, or ``UnknownProduct``."""
    product = PRODUCTS.get(name)
    if product is None or (form and form not in product.formats):
        raise UnknownProduct(f"{name!r} with format {form!r}")
    return product, form or product.default


def decide(calculated: Column, quoted: Column, keyed: Column, reference: Column) -> tuple[Column, Column]:
    """Status and reason of a draft, the first that applies: a calculation with a wrong key,
    a quotation that doesn't hold, a wrong key, a named source; else it awaits review."""
    reason = F.when(calculated & ~keyed, "key").when(~quoted, "quotation").when(~keyed, "key").when(reference != "", "source")
    return F.when(reason.isNotNull(), "rejeitada").otherwise("pendente_revisao"), reason


def judge_drafts(drafts: DataFrame, product: Product, keep: Keep, verifier: Seam | None = None) -> DataFrame:
    """Adds ``citacao_validada``, ``status`` and ``motivo_rejeicao`` to drafts.

    Drafts have enunciado, comentario, resposta, resolucao, alternativas, gabarito,
    formato, materia and trecho. The verifier (rows in, the same rows with boolean ``key_ok`` out)
    only sees drafts whose quotation holds or that have a calculation; what it says is kept
    once. Rows with ``error`` pass by unjudged.
    """
    calculated = filled(F.col("resolucao"))
    text = F.coalesce(first_filled(F.col("comentario"), F.col("resposta")), F.lit(""))
    held = quotations_hold(text, F.coalesce("trecho", F.lit("")), F.lit(product.quotation_required) & ~calculated)
    rows = drafts.withColumns({"_calc": F.coalesce(calculated, F.lit(False)), "citacao_validada": held})
    failed = F.col("error").isNotNull() if "error" in drafts.columns else F.lit(False)
    asked = ~failed & (F.col("citacao_validada") | F.col("_calc"))
    if verifier is not None and product.quotation_required:
        rows = keep(verifier(rows.where(asked)), "verified").unionByName(rows.where(~asked).withColumn("key_ok", F.lit(True)))
    else:
        rows = rows.withColumn("key_ok", F.lit(True))
    reference = source_reference(F.col("enunciado"), F.col("comentario"), F.col("resposta"), F.col("alternativas"), F.col("formato"), F.col("materia"))
    status, reason = decide(F.col("_calc"), F.col("citacao_validada"), F.col("key_ok"), reference)
    judged = {"status": F.when(~failed, status), "motivo_rejeicao": F.when(~failed, reason), "citacao_validada": F.when(~failed, F.col("citacao_validada"))}
    return rows.withColumns(judged).drop("_calc", "key_ok")


def generate_twice(rows: DataFrame, generator: Seam, keep: Keep) -> DataFrame:
    """Drafts of the first attempt without a source reference, and second attempts for the rest.

    The generator turns request rows (with ``i``) into drafts (with ``i``). It may be random
    or costly: each attempt is kept before anything looks at it, so it runs once for each
    request and attempt. Failures (rows with ``error``) aren't tried again, and a request
    that has no draft at all becomes one.
    """
    reference = source_reference(F.col("enunciado"), F.col("comentario"), F.col("resposta"), F.col("alternativas"), F.col("formato"), F.col("materia"))

    def attempt(asked: DataFrame, number: int) -> DataFrame:
        made = generator(asked)
        made = made if "error" in made.columns else made.withColumn("error", F.lit(None).cast("string"))
        made = keep(made, f"attempt_{number}")
        silent = asked.join(made.select("i"), "i", "left_anti").select("i", *[c for c in asked.columns if c in made.columns and c != "i"], F.lit("no draft").alias("error"))
        return made.unionByName(silent, allowMissingColumns=True).withColumn("attempt", F.lit(number))

    first = attempt(rows, 1)
    named = F.col("error").isNull() & (reference != "")
    again = attempt(rows.join(first.where(named).select("i"), "i", "left_semi"), 2)
    return first.where(~named).unionByName(again)


def per_request(make: Callable[[dict], dict], schema: str) -> Seam:
    """A seam of a function that makes one draft of one request, both as dicts.

    A request that raises becomes a row with ``error`` and doesn't end the batch. ``schema``
    names the draft's columns; the request's own columns come along.
    """

    def seam(requests: DataFrame) -> DataFrame:
        given = requests.columns
        own = [f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema]
        fields = [f.strip().split()[0] for f in re.split(r",(?![^<]*>)", schema)]
        more = [f.strip() for f in re.split(r",(?![^<]*>)", schema) if f.strip().split()[0] not in given]

        def run(frames):
            for f in frames:
                out = []
                for row in f.to_dict("records"):
                    try:
                        out.append(row | {k: v for k, v in make(dict(row)).items() if k in fields} | {"error": None})
                    except Exception as e:  # one bad request doesn't end the batch
                        out.append(row | {"error": f"{type(e).__name__}: {e}"})
                names = [*given, *[m.split()[0] for m in more], "error"]
                yield pd.DataFrame([[r.get(c) for c in names] for r in out], columns=names, dtype=object)

        return requests.mapInPandas(run, ", ".join([*own, *more, "error string"]))

    return seam


def plan_batch(topics: DataFrame, quantity: int, order: str, subject: str | None = None) -> DataFrame:
    """``quantity`` requests: topics in turn, of those whose subject or title matches ``subject``."""
    if subject:
        wanted = fold(F.lit(subject))
        topics = topics.where(names_match(wanted, fold(F.col("materia"))) | names_match(wanted, fold(F.col("tema"))))
    return round_robin(topics, order, quantity)


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: drafts that await review, rejected ones, and failures (rows with ``error``)."""
    return results.agg(
        F.count_if(F.col("error").isNull() & (F.col("status") == "pendente_revisao")).alias("pending"),
        F.count_if(F.col("error").isNull() & (F.col("status") == "rejeitada")).alias("rejected"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
