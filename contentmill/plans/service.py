"""The bank as a service: catalog, draws, review, intake and generation over stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmill import schemas
from contentmill.functions.naming import exam_code_of, subject_name, subject_name_of
from contentmill.functions.text import content_hash, filled
from contentmill.operators import catalog, draws, generation, matching, parsing, store
from contentmill.sources import files


class Bank:
    """Questions and passages as versioned tables below ``root``.

    ``now`` gives the time that is stamped on changes. Queries return lazy DataFrames;
    changes write one new version of a table each.
    """

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self.spark, self.root, self.now = spark, root, now
        self._seen: dict[str, int] = {}
        self.staging = files.Staging(spark, f"{root}/staged")

    @property
    def questions(self) -> DataFrame:
        return self._read("questoes", schemas.QUESTIONS)

    @property
    def passages(self) -> DataFrame:
        return self._read("material_fonte", schemas.PASSAGES)

    def _stamp(self) -> Column:
        return F.lit(self.now()).cast("timestamp")

    def _replace(self, df: DataFrame, name: str) -> DataFrame:
        """A new version of a table, computed from the one that was last read here."""
        return files.replace_table(df, f"{self.root}/{name}", based_on=self._seen.pop(name, None))

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return files.replace_table(df, f"{self.root}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        self._seen[name] = files.version(self.spark, f"{self.root}/{name}")
        return files.read_latest(self.spark, f"{self.root}/{name}", schema)

    # Catalog

    def exams(self) -> DataFrame:
        return catalog.distinct_sorted(self.questions.where("status = 'aprovada'"), "concurso")

    def subjects(self, exam: str) -> DataFrame:
        """Subjects with approved stock."""
        return catalog.distinct_sorted(self._approved(exam), "materia")

    def subjects_to_generate(self, exam: str) -> DataFrame:
        code = exam_code_of(exam)
        return catalog.names_to_generate(self.passages.where(F.col("concurso") == code), self._bank_comments(code), "materia")

    def topics(self, exam: str) -> DataFrame:
        """Topics of the books in book order, then those of bank questions whose subject no book covers."""
        code = exam_code_of(exam)
        books = self.passages.where(F.col("concurso") == code)
        bank = matching.fuzzy_anti(self._bank_comments(code).where(filled(F.col("tema"))), "materia", books, "materia")
        book_order = books.withColumn("ordem", F.coalesce(F.col("ordem").cast("long"), F.lit(0).cast("long")))
        return catalog.first_seen([(book_order, ["materia", "ordem", "id"]), (bank.withColumn("zero", F.lit("")).withColumn("none", F.lit(0).cast("long")), ["zero", "none", "id"])], ["materia", "tema"])

    def _bank_comments(self, code: str | None) -> DataFrame:
        q = self.questions.where("origem = 'banco_real' and status = 'aprovada'").where(filled(F.col("comentario")))
        return q.where(F.col("concurso") == code) if code else q

    def sources(self, exam: str | None = None, subject: str | None = None) -> DataFrame:
        df = catalog.where_given(self.passages, equal={"concurso": exam}, same={"materia": subject_name_of(subject)})
        return catalog.listing(df, ["concurso", "materia", F.coalesce("ordem", F.lit(0)), "id"], sizes={"trecho": "tamanho_trecho"})

    def source(self, key: int) -> DataFrame:
        found = catalog.by_id(self.passages, "id", key)
        if found.isEmpty():
            raise store.Missing(key)
        return found

    def curated(self, exam: str | None = None, subject: str | None = None, origin: str | None = None, status: str | None = None) -> DataFrame:
        df = catalog.where_given(self.questions, equal={"concurso": exam, "origem": origin, "status": status}, same={"materia": subject_name_of(subject)}, among={"origem": store.CURATED_ORIGINS})
        return catalog.listing(df, ["concurso", "materia", "id"], short={"enunciado": 200})

    def example(self, exam: str, subject: str, form: str | None = None) -> DataFrame:
        """One approved bank question of the subject and form, to calibrate on."""
        q = catalog.where_given(self._bank_comments(exam_code_of(exam)), equal={"formato": form}, same={"materia": subject_name_of(subject)})
        return draws.any_one(q, "id")

    def existing_stems(self, exam: str, subject: str, topic: str, origin: str) -> DataFrame:
        q = self.questions.where((F.col("concurso") == exam_code_of(exam)) & (F.col("materia") == subject) & (F.col("tema") == topic) & (F.col("origem") == origin))
        return catalog.newest_block(q, ["concurso"], "id", "enunciado")

    def passage_for(self, subject: str, topic: str, exam: str | None = None, seed: int = 0) -> DataFrame:
        """The passage of a topic, else an approved bank question's comment, by a seeded pick."""
        name = subject_name_of(subject)
        same = lambda df: catalog.where_given(df, equal={"concurso": exam_code_of(exam)}, same={"materia": name, "tema": topic})
        book = same(self.passages).select("concurso", "materia", "tema", "id", "trecho").orderBy("id").limit(1)
        bank = draws.any_by_seed(same(self._bank_comments(None)).select("concurso", "materia", "tema", "id", F.col("comentario").alias("trecho")), "id", seed)
        found = matching.first_tier([book.withColumn("one", F.lit(1)), bank.withColumn("one", F.lit(1))], ["one"], "id").drop("one")
        if found.isEmpty():
            raise store.Missing((subject, topic))
        return found

    # Draws

    def _approved(self, exam: str, subject: str | None = None, form: str | None = None) -> DataFrame:
        q = self.questions.where("status = 'aprovada'")
        return catalog.where_given(q, equal={"formato": form}, same={"concurso": exam_code_of(exam), "materia": subject_name_of(subject)})

    def draw(self, exam: str, quantity: int, form: str | None = None) -> DataFrame:
        """Draws by reuse priority and stamps the use; ``ShortStock`` changes nothing."""
        return self._use(draws.draw(self._approved(exam, form=form), quantity, "usada_em", "id"))

    def draw_stratified(self, exam: str, distribution: Mapping[str, int], form: str | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(subject_name_of(s), s, n, i) for i, (s, n) in enumerate(distribution.items())], "materia string, pedida string, quantity int, position int")
        stock, quotas = self._approved(exam, form=form), asked.select("materia", "quantity", "position")
        short = draws.shortages(stock, quotas, "materia").orderBy("materia").collect()
        if short:
            raise draws.ShortStock("; ".join(f"{r.materia}: {r.quantity} asked for, {r.available} in stock" for r in short))
        drawn = draws.draw_stratified(stock, quotas, "materia", "usada_em", "id", largest=max(distribution.values()))
        return self._use(drawn.select(*stock.columns, "position", "rank"))

    def _use(self, drawn: DataFrame) -> DataFrame:
        drawn = files.replace_table(drawn, f"{self.root}/draws")
        self._replace(store.append_use(self.questions, drawn, "id", "usada_em", self._stamp()), "questoes")
        order = ["position", "rank"] if "position" in drawn.columns else draws.reuse_order("usada_em", "id")
        return drawn.orderBy(*order)

    # Changes

    def _add(self, rows: DataFrame, name: str, keys: Sequence[str], defaults: Mapping[str, Column]) -> tuple[int, int]:
        """Inserted and duplicate counts; stored rows win, and the first of a key in input order."""
        stored = self.questions if name == "questoes" else self.passages
        placed = files.replace_table(rows.withColumn("_place", F.monotonically_increasing_id()), f"{self.root}/incoming")
        fresh = store.new_rows(placed, stored, keys, "_place")
        fresh = store.next_ids(stored, fresh.drop("id"), "_place").drop("_place")
        fresh = fresh.withColumns({c: v for c, v in defaults.items() if c not in fresh.columns} | {"created_at": self._stamp()})
        fresh = stored.limit(0).unionByName(fresh.select(*[c for c in stored.columns if c in fresh.columns]), allowMissingColumns=True)
        inserted = files.append_rows(fresh, f"{self.root}/{name}", based_on=self._seen.pop(name, None)).count()
        return inserted, placed.count() - inserted

    def add_questions(self, rows: DataFrame) -> tuple[int, int]:
        """Curated questions: subject in its one name, status from whether an image is needed."""
        rows = store.prepare_curated(rows)
        if "hash_conteudo" not in rows.columns:
            rows = rows.withColumn("hash_conteudo", content_hash(F.col("enunciado")))
        return self._add(rows, "questoes", schemas.QUESTION_KEY, {"usada_em": F.array().cast("array<timestamp>"), "updated_at": self._stamp()})

    def add_passages(self, rows: DataFrame) -> tuple[int, int]:
        rows = rows.withColumn("materia", subject_name(F.col("materia")))
        return self._add(rows, "material_fonte", schemas.PASSAGE_KEY, {})

    def delete_questions(self, ids: Sequence[int]) -> DataFrame:
        """Deletes curated questions only; returns the deleted rows."""
        return self._delete("questoes", store.delete_curated(self.questions, self._ids(ids)))

    def delete_passages(self, ids: Sequence[int]) -> DataFrame:
        return self._delete("material_fonte", store.delete_returning(self.passages, self._ids(ids), "id"))

    def _ids(self, ids: Sequence[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id long")

    def _delete(self, name: str, parts: tuple[DataFrame, DataFrame]) -> DataFrame:
        kept, gone = parts
        gone = files.replace_table(gone, f"{self.root}/deleted_{name}")
        self._replace(kept, name)
        return gone

    def review(self, key: int, decision: str, reviewer: str | None = None, reason: str | None = None) -> DataFrame:
        told = self.spark.createDataFrame([(key, decision, reviewer, reason)], "id long, decision string, reviewer string, reason string")
        done = self._replace(store.review(self.questions, told, at=self._stamp()), "questoes")
        return done.where(F.col("id") == key)

    # Intake of documents

    def preview(self, pages: DataFrame, parser: str, exam: str, subject: str | None = None, origin: str = "banco_real") -> tuple[str, DataFrame, DataFrame]:
        """Parses and stages documents (name, pages): the key, the first rows, and failures."""
        docs = pages.withColumn("subject", F.lit(subject).cast("string"))
        parsed = parsing.parse_documents(docs, parser, id_col="name", subject_col="subject")
        rows = parsed.where("kind = 'row'").withColumns({"concurso": F.lit(exam), "arquivo_origem": F.col("name"), "origem": F.lit(origin)})
        book = parser in ("combined_book", "single_book")
        key = self.staging.stage(rows.select(*schemas.columns(schemas.PASSAGE_FILE)) if book else rows.select(*[c for c in schemas.columns(schemas.QUESTION_FILE) if c != "status"]))
        return key, catalog.preview(rows.orderBy("name", "place"), "place")[0], parsed.where("kind <> 'row'").select("name", "kind", "numero", "motivo")

    def confirm(self, key: str) -> tuple[int, int]:
        """Stores staged rows, once."""
        return self.staging.confirm(key, lambda rows: self.add_passages(rows) if "trecho" in rows.columns else self.add_questions(rows))

    # Generation

    def generate(self, exam: str, quantity: int, generator: generation.Seam, *, product: str = "mestre_questoes", form: str | None = None, subject: str | None = None, verifier: generation.Seam | None = None) -> DataFrame:
        """Judged drafts for topics in turn; the generator makes drafts of requests (i, materia, tema).

        A topic whose generation fails is a row with ``error``; the others go on.
        """
        kind, form = generation.product_format(product, form)
        topics = self.topics(exam).withColumn("_place", F.monotonically_increasing_id())
        requests = generation.plan_batch(topics, quantity, "_place", subject).select("i", "materia", "tema", F.lit(exam_code_of(exam)).alias("concurso"), F.lit(form).cast("string").alias("formato"))
        requests = files.replace_table(requests, f"{self.root}/requests")
        drafts = generation.generate_twice(requests, generator, self._keep)
        return generation.judge_drafts(drafts, kind, self._keep, verifier)


#: The tools that a chat may call by name, each with the names of its arguments.
TOOLS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "listar_concursos": (Bank.exams, ()),
    "listar_materias": (Bank.subjects, ("exam",)),
    "listar_materias_geracao": (Bank.subjects_to_generate, ("exam",)),
    "montar_simulado": (lambda bank, exam, quantity=None, distribution=None, form=None: bank.draw_stratified(exam, distribution, form) if distribution else bank.draw(exam, quantity, form), ("exam", "quantity", "distribution", "form")),
    "gerar_questoes": (Bank.generate, ("exam", "quantity", "generator", "product", "form", "subject", "verifier")),
}


def call_tool(bank: Bank, name: str, arguments: Mapping[str, object]) -> DataFrame:
    """Runs a registered tool; an unknown name or argument raises ``KeyError``."""
    tool, known = TOOLS[name]
    unknown = set(arguments) - set(known)
    if unknown:
        raise KeyError(", ".join(sorted(unknown)))
    return tool(bank, **arguments)
