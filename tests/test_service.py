import datetime as dt

import pytest
from pyspark.sql import functions as F

from contentmill import schemas
from contentmill.operators import draws, store
from contentmill.plans.service import Bank, call_tool
from tests.test_parsing import BOOK


@pytest.fixture
def bank(spark, tmp_path):
    b = Bank(spark, str(tmp_path), now=lambda: dt.datetime(2025, 1, 1, tzinfo=dt.UTC))
    question = lambda i, subject, topic: ("BB", subject, topic, "banco_real", "certo_errado", None, None, f"stem {i}", None, "CERTO", "comment", "f.pdf", f"h{i}")
    ddl = ", ".join(x for x in schemas.QUESTION_FILE.split(", ") if not x.startswith("status"))
    rows = [question(i, ("Dir Penal", "RLM")[i % 2], f"t{i % 3}") for i in range(8)]
    assert b.add_questions(spark.createDataFrame([*rows, rows[0]], ddl).coalesce(1)) == (8, 1)
    passages = [("BB", "a.pdf", "Direito Penal", f"T{i}", i, None, f"trecho {i}", f"p{i}") for i in range(3)]
    assert b.add_passages(spark.createDataFrame(passages, schemas.PASSAGE_FILE).coalesce(1)) == (3, 0)
    return b


def test_bank(bank, spark):
    assert [r[0] for r in bank.exams().collect()] == ["BB"]
    assert [r[0] for r in bank.subjects("Banco do Brasil").collect()] == ["Direito Penal", "Raciocínio Lógico Matemático"]
    assert [r[0] for r in bank.subjects_to_generate("BB").collect()] == ["Direito Penal", "Raciocínio Lógico Matemático"]
    topics = [(r.materia, r.tema) for r in bank.topics("BB").collect()]
    assert topics[:3] == [("Direito Penal", f"T{i}") for i in range(3)] and {m for m, _ in topics[3:]} == {"Raciocínio Lógico Matemático"}
    assert [r.tamanho_trecho for r in bank.sources("BB").collect()] == [8, 8, 8]
    assert bank.passage_for("Direito Penal", "t1").count() == 1 and bank.passage_for("RLM", "t1").first().trecho == "comment"
    with pytest.raises(store.Missing):
        bank.source(99)
    assert bank.curated(subject="rlm").count() == 4 and bank.example("BB", "RLM").first().id == 2
    first = [r.id for r in call_tool(bank, "montar_simulado", {"exam": "BB", "distribution": {"RLM": 2, "Dir Penal": 1}}).collect()]
    assert first == [2, 4, 1]
    assert [r.id for r in bank.draw("BB", 2).collect()] == [3, 5]
    with pytest.raises(draws.ShortStock):
        bank.draw_stratified("BB", {"RLM": 2, "Dir Penal": 9})
    assert bank.questions.where("size(usada_em) = 1").count() == 5
    assert bank.review(1, "rejeitada", "r", "bad").first().motivo_rejeicao == "bad"
    assert [r.id for r in bank.delete_questions([1, 2]).orderBy("id").collect()] == [1, 2] and bank.questions.count() == 6
    with pytest.raises(KeyError):
        call_tool(bank, "listar_concursos", {"x": 1})


def test_preview_and_generate(bank, spark):
    pages = spark.createDataFrame([("b.pdf", [BOOK])], "name string, pages array<string>")
    key, rows, failures = bank.preview(pages, "question_book", "TJSP", "Dir Penal")
    assert rows.count() == 2 and failures.count() == 2
    assert bank.confirm(key) == (2, 0)
    with pytest.raises(KeyError):
        bank.confirm(key)
    none = F.lit(None).cast("string")
    make = lambda r: r.select("i", "materia", "tema", "formato", F.lit("s").alias("enunciado"), F.lit('"trecho"').alias("comentario"), none.alias("resposta"), none.alias("resolucao"), F.lit(None).cast("map<string,string>").alias("alternativas"), F.lit("C").alias("gabarito"), F.lit("um trecho").alias("trecho"))
    out = bank.generate("BB", 4, make, subject="Penal").collect()
    assert sorted((r.i, r.tema, r.status) for r in out) == [(0, "T0", "pendente_revisao"), (1, "T1", "pendente_revisao"), (2, "T2", "pendente_revisao"), (3, "T0", "pendente_revisao")]
