from pyspark.sql import functions as F

from contentmill.functions import naming, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(s):
    return F.lit(s).cast("string")


def test_names_match(spark):
    cases = [("op bloco i", "op bloco iii", False), ("op bloco 3", "operacao bloco iii", True), ("bloco 1", "op bloco 10", False), ("", "x", False), ("", "", False), ("penal", "direito penal", True), ("a", "ab", False)]
    for a, b, expected in cases:
        assert value(spark, text.names_match(lit(a), lit(b))) is expected, (a, b)
        assert value(spark, text.names_match(lit(b), lit(a))) is expected, (b, a)


def test_fold(spark):
    assert value(spark, text.fold(lit("Raciocínio–Lógico nº 3"))) == "raciociniologico no 3"
    assert value(spark, text.fold_any(lit("Raciocínio–Lógico nº 3"))) == "raciociniologico no 3"
    assert value(spark, text.fold(lit("A-B"))) == "a b"


def test_names(spark):
    for given, expected in (("RLM", "Raciocínio Lógico Matemático"), ("Dir Penal", "Direito Penal"), (" Xadrez ", "Xadrez"), ("", ""), (None, None)):
        assert value(spark, naming.subject_name(lit(given))) == expected
    assert value(spark, naming.exam_code(lit("Banco do Brasil"))) == "BB"
    assert value(spark, naming.exam_code(lit("XYZ"))) == "XYZ"


def test_quotations(spark):
    def holds(s, passage, required=True):
        return value(spark, text.quotations_hold(lit(s), lit(passage), F.lit(required)))

    assert holds('"A B [...] 13º dia"', "xx ab yy 13° DIA")
    assert not holds("no quote", "x") and holds("no quote", "x", False)
    assert not holds('"absent"', "present")
    assert holds("‘a–b’ e “c • d”", "A-B C D")
    assert value(spark, text.quotations(lit("\"a\" 'b' “c\nd” ‘e’"))) == ["a", "b", "c\nd", "e"]


def test_answers_and_options(spark):
    options = F.create_map(*[F.lit(x) for k in "ABCDE" for x in (k, "t")])
    none = F.lit(None).cast("map<string,string>")
    for form, raw, o, expected in (("certo_errado", "Certo.", none, "CERTO"), ("abcde", "B", options, "B"), ("abcde", "F", options, None), ("abcde", "C - x", options, "C"), (None, "A", options, None)):
        assert value(spark, text.answer_key(lit(form), lit(raw), o)) == expected
    assert value(spark, text.option_map(lit("A) x\nB) y"))) is None
    assert value(spark, text.option_map(lit("Q\nA) x\n  y\nB) q\nB) z\nC) w"))) == {"A": "x y", "B": "z", "C": "w"}
    assert value(spark, text.option_map(lit("(A) x\n(B) y\n(C) z"), bracketed=True)) == {"A": "x", "B": "y", "C": "z"}


def test_images_and_sources(spark):
    assert value(spark, text.needs_image(lit("Observe a figura abaixo"))) is True
    assert value(spark, text.needs_image(lit("A figura do réu"))) is False
    none, no_map = lit(None), F.lit(None).cast("map<string,string>")

    def found(stem, form=None, subject=None):
        return value(spark, text.source_reference(lit(stem), none, none, no_map, lit(form), lit(subject)))

    assert found("Como o trecho informa") == "o trecho informa"
    assert found("as outras alternativas", "certo_errado") == "outras alternativas" and found("as outras alternativas", "abcde") == ""
    assert found("o texto afirma", None, "Direito Penal") == "o texto afirma" and found("o texto afirma", None, "Língua Portuguesa") == ""


def test_letters(spark):
    m = F.create_map(F.lit("A"), F.lit("C"), F.lit("B"), F.lit("A"))
    assert value(spark, text.remap_letters(lit("alternativa B e a letra a"), m)) == "alternativa A e a letra C"
    assert value(spark, text.remap_letters(lit("o item a seguir"), F.create_map(F.lit("A"), F.lit("C")))) == "o item C seguir"
    options = F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y"), F.lit("C"), F.lit("z"))
    out = value(spark, text.shuffle_options(options, F.lit("B"), F.lit(7), {"comment": F.lit("letra B")}))
    assert sorted(out.options.values()) == ["x", "y", "z"] and out.options[out.key] == "y" and out.comment == f"letra {out.key}"
    same = value(spark, text.shuffle_options(options, F.lit("E"), F.lit(7), {"comment": F.lit("letra B")}))
    assert same.options == {"A": "x", "B": "y", "C": "z"} and same.key == "E" and same.comment == "letra B"


def test_files_and_shapes(spark):
    parts = value(spark, text.name_parts(lit("d/01 - INSS - MQ DIGITAL - Ética no Serviço Público.pdf")))
    assert (parts.exam, parts.subject) == ("INSS", "Ética no Serviço Público")
    assert value(spark, text.name_parts(lit("MPSP-OP - MQ DIGITAL - X.pdf"))).exam is None
    assert value(spark, text.subject_after_mark(lit("02 TJSP MEQ DIGITAL - Penal.docx"))) == "Penal"
    assert value(spark, text.subject_of_book(lit("01 - PETROBRAS - Esquematizada - Química.pdf"), F.lit("PETR"))) == "Química"
    assert value(spark, text.subject_of_book(lit("03 - BB - Inglês.pdf"), F.lit("BB"))) == "Inglês"
    assert value(spark, text.join_broken_numbers(lit("QUESTÃO 6 4: x"))) == "QUESTÃO 64: x"
    assert value(spark, text.shortened(lit("x" * 200))) == "x" * 200 and value(spark, text.shortened(lit("x" * 201))) == "x" * 200 + "..."
    filled = text.fill_template("a {x}{n_block}", {"x": lit("1"), "n": lit("")}, {"n": " n={n}"})
    assert value(spark, filled) == "a 1"
    assert value(spark, text.first_filled(lit(""), lit(None), lit("b"))) == "b"
