import json
import zipfile

import pytest

from contentmill import schemas
from contentmill.operators import catalog
from contentmill.sources import files
from contentmill.streaming import intake

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, paragraphs):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')


def test_documents(spark, tmp_path):
    (tmp_path / "BB").mkdir()
    docx(tmp_path / "BB" / "01 - BB - MQ Digital - x.docx", [("H1", "Title"), ("", "text")])
    (tmp_path / "BB" / "02 - MQ DIGITAL.pdf").write_bytes(b"%PDF")
    (tmp_path / "BB" / "other.docx").write_bytes(b"bad")
    found = files.read_files(spark, f"{tmp_path}/*/*", name_like=["MQ DIGITAL"], exam_level=1)
    assert sorted((r.name, r.exam) for r in found.collect()) == [("01 - BB - MQ Digital - x.docx", "BB"), ("02 - MQ DIGITAL.pdf", "BB")]
    pages = {r.name: (r.pages, r.error) for r in files.read_pages(found).collect()}
    assert pages["01 - BB - MQ Digital - x.docx"] == (["Title\ntext"], None) and "NotInstalled" in pages["02 - MQ DIGITAL.pdf"][1]
    assert {tuple(r.pages) for r in files.read_pages(found, pdf=lambda b: ["p", None]).where("name like '%pdf'").collect()} == {("p", "")}
    styles = files.read_paragraphs(found.where("name like '%docx'")).orderBy("idx").collect()
    assert [(r.style, r.text) for r in styles] == [("Heading 1", "Title"), ("Normal", "text")]
    both = files.read_paragraphs(files.read_files(spark, f"{tmp_path}/BB/*.docx")).collect()
    assert len(both) == 3 and [r.path.rsplit("/", 1)[1] for r in both if r.error] == ["other.docx"]


def test_json_and_csv(spark, tmp_path):
    row = dict(concurso="c", arquivo_origem="a", materia="m", tema="t", ordem=1, pagina=None, trecho='x "q"\ny', hash_conteudo="h")
    (tmp_path / "a.json").write_text(json.dumps([row | {"extra": 1}], ensure_ascii=False))
    assert files.read_json_array(spark, str(tmp_path / "a.json"), schemas.PASSAGE_FILE).first().asDict() == row
    (tmp_path / "a.csv").write_text("concurso,arquivo_origem,materia,tema,ordem,pagina,trecho,hash_conteudo\n" + 'c,a,m,t,1,,"x ""q""\ny",h\n')
    assert files.read_csv(spark, str(tmp_path / "a.csv"), schemas.PASSAGE_FILE).first().asDict() == row
    (tmp_path / "less.json").write_text(json.dumps([row, {k: v for k, v in row.items() if k != "tema"}]))
    with pytest.raises(Exception, match="missing keys: tema"):
        files.read_json_array(spark, str(tmp_path / "less.json"), schemas.PASSAGE_FILE).collect()
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        files.read_json_array(spark, str(tmp_path / "bad.json"), schemas.PASSAGE_FILE).collect()


def test_versions_staging_and_summary(spark, tmp_path):
    root = str(tmp_path / "t")
    assert files.read_latest(spark, root, "x long").count() == 0
    files.replace_table(spark.range(2).toDF("x"), root)
    again = files.replace_table(files.read_latest(spark, root, "x long").union(spark.range(1).toDF("x")), root)
    assert again.count() == 3 and files.version(spark, root) == 2
    files.append_rows(spark.range(5, 6).toDF("x"), root)
    assert sorted(r.x for r in files.read_latest(spark, root, "x long").collect()) == [0, 0, 1, 5]
    # Of two writers that read the same version, the second is told.
    seen = files.version(spark, root)
    files.append_rows(spark.range(1).toDF("x"), root, based_on=seen)
    for change in (files.replace_table, files.append_rows):
        with pytest.raises(files.Stale):
            change(spark.range(9).toDF("x"), root, based_on=seen)
    assert files.read_latest(spark, root, "x long").count() == 5
    stage = files.Staging(spark, str(tmp_path / "s"))
    key = stage.stage(spark.range(3))
    with pytest.raises(ZeroDivisionError):
        stage.confirm(key, lambda d: 1 // 0)
    assert stage.preview(key).count() == 3 and stage.confirm(key, lambda d: d.count()) == 3
    with pytest.raises(KeyError):
        stage.confirm(key, lambda d: d.count())
    lists = catalog.grouped_lists(spark.createDataFrame([("m", 1, "b"), ("m", 0, "a")], "m string, o int, t string"), "m", "o", "t")
    files.write_summary(lists, "m", str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["m: 2", "  - a", "  - b"]


def test_intake_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"k": "a"}, {"k": "a"}, {"k": "b"}]))
    run = lambda n: intake.intake(intake.watch_json(spark, str(tmp_path / "in"), "k string"), str(tmp_path / "t"), str(tmp_path / f"c{n}"), schema="k string", keys=["k"]).awaitTermination()
    run(0)
    run(0)
    run(1)
    assert sorted(r.k for r in intake.stored_rows(spark, str(tmp_path / "t"), "k string").collect()) == ["a", "b"]


def test_a_batch_opens_only_the_buckets_of_its_keys(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "k long, x string"
    add = lambda rows: intake.add_rows(spark.createDataFrame(rows, "k long, x string, o int, more int"), root, schema=schema, keys=["k"], order="o", buckets=16)
    add([])
    assert intake.stored_rows(spark, root, schema).count() == 0
    add([(i, "old", i, 0) for i in range(60)])
    of = {r.k: r.b for r in spark.range(200).withColumnRenamed("id", "k").withColumn("b", intake.bucket_of(["k"], 16)).collect()}
    bad = of[3]
    for f in (tmp_path / "t" / f"_bucket={bad}").glob("part-*"):
        f.write_bytes(b"damaged")
    good = [k for k in range(200) if of[k] != bad]
    add([(k, x, o, 0) for k in good for x, o in (("new", 1), ("again", 2))])
    kept = [b for b in range(16) if b != bad]
    assert {r.k: r.x for r in intake.stored_rows(spark, root, schema, kept).collect()} == {k: "old" if k < 60 else "new" for k in good}
    with pytest.raises(Exception, match="(?i)parquet|damaged|footer"):
        add([(3, "x", 1, 0)])
    plan = intake.stored_rows(spark, root, schema, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan and " IN (1,2)" in plan
