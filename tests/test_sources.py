from pyspark.sql import functions as F

from serospark.functions.constants import AMINO_ACIDS
from serospark.sources import fasta, ledger, properties, tables, web

RECORDS = """H GOOD010101
D complete
I    A/L     R/K     N/M     D/F     C/P     Q/S     E/T     G/W     H/Y     I/V
     1.      2.      3.      4.      5.      6.      7.      8.      9.     10.
    11.     12.     13.     14.     15.     16.     17.     18.     19.    -20.5
//
H GAPS010101
I    A/L     R/K
     1.      2.      3.      4.      5.      6.      7.      8.      9.     10.
    11.     12.     13.     14.      NA     16.     17.     18.     19.     20.
//
H SHORT010101
I    A/L
     1.      2.
//
"""


def test_scalar_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text(RECORDS)
    got = properties.read_property_records(spark, str(tmp_path)).collect()
    assert [r["prop"] for r in got] == ["GOOD010101"]
    by_letter = dict(zip(AMINO_ACIDS, got[0]["vals"]))
    assert [by_letter[c] for c in "ALRKNM"] == [1, 2, 3, 4, 5, 6] and by_letter["V"] == -20.5


def matrix_record(code, rows, cols, lines):
    return f"H {code}\nD text\nM rows = {rows}, cols = {cols}\n" + "\n".join(lines) + "\n//\n"


def test_matrix_records(spark, tmp_path, rows):
    full = ["  " + "  ".join(str(20 * i + j) + "." for j in range(20)) for i in range(20)]
    half = [" ".join(str(10 * i + j) for j in range(i + 1)) for i in range(20)]
    text = (matrix_record("FULL", AMINO_ACIDS, AMINO_ACIDS, full) + matrix_record("HALF", AMINO_ACIDS, AMINO_ACIDS, [*half, "note 5"])
            + matrix_record("ODD", "AR-", "AR-", ["1", "2 3", "4 5 6.25"]) + matrix_record("BAD", "AR", "AR", ["1 2 3 4 5"]) + matrix_record("NAN", "AR", "AR", ["1", "2 NA"]))
    (tmp_path / "a.txt").write_text(text)
    strict = properties.matrices_to_cells(properties.read_property_matrices(spark, str(tmp_path)))
    cells = {r["prop"]: r["cells"] for r in strict.collect()}
    assert set(cells) == {"FULL", "HALF"}
    assert cells["FULL"] == [float(i) for i in range(400)]
    assert cells["HALF"][20 * 3 + 1] == cells["HALF"][20 * 1 + 3] == 31.0
    any_letters = properties.read_property_matrices(spark, str(tmp_path), alphabet=None)
    out = str(tmp_path / "csv")
    properties.write_property_matrices(any_letters, out)
    back = properties.read_matrix_csvs(spark, out)
    assert rows(back.filter("prop = 'ODD'"), "aa_i", "aa_j", "value") == [
        ("-", "-", 6.25), ("-", "A", 4.0), ("-", "R", 5.0), ("A", "-", 4.0), ("A", "A", 1.0), ("A", "R", 2.0), ("R", "-", 5.0), ("R", "A", 2.0), ("R", "R", 3.0)]
    assert sorted(r[0] for r in back.select("prop").distinct().collect()) == ["FULL", "HALF", "ODD"]


def test_json_of_a_whole_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "P1": {"A": 1.5, "V": 2},\n "P2": {"A": 0}\n}')
    got = {r["prop"]: r["vals"] for r in properties.read_property_json(spark, str(tmp_path / "a.json"), whole_file=True).collect()}
    assert got["P1"][0] == 1.5 and got["P1"][19] == 2.0 and got["P2"][1] is None


def test_fasta(spark, tmp_path, rows):
    (tmp_path / "a.fasta").write_text(">x A/HK/1/68 | more\r\nACD\r\nEF\n>y|z\nGG-\n")
    (tmp_path / "b.fasta").write_text(">w\n\nKK\n")
    got = fasta.read_fasta(spark, str(tmp_path))
    assert rows(got, "id", "description", "seq") == [("w", "w", "KK"), ("x", "x A/HK/1/68 | more", "ACDEF"), ("y|z", "y|z", "GG-")]
    first = got.filter(F.col("file").endswith("a.fasta")).orderBy("pos").first()
    assert first["id"] == "x"


def test_titre_folder_and_name_map(spark, tmp_path, rows):
    (tmp_path / "2003-aug.csv").write_text("Test Virus,Reference Virus,Titre\nA/x,A/y,<40\nA/x,A/z,0160\n")
    (tmp_path / "notes.txt").write_text("skip")
    assert rows(tables.read_titres(spark, str(tmp_path))) == [("A/x", "A/y", "<40", "2003-aug"), ("A/x", "A/z", "0160", "2003-aug")]
    names = tmp_path / "names.csv"
    names.write_bytes("﻿full_name,short_name\r\nA/Bilt,BI/1\r\n\r\n".encode())
    assert rows(tables.read_name_map(spark, str(names))) == [("A/Bilt", "BI/1")]


def test_matrix_names_with_dots(spark, tmp_path, rows):
    (tmp_path / "m.csv").write_text('"","a.1","b/2"\n"a.1",0,1.5\n"b/2",1.5,0\n')
    assert rows(tables.read_distance_matrix(spark, str(tmp_path / "m.csv"))) == [("a.1", "a.1", 0.0), ("a.1", "b/2", 1.5), ("b/2", "a.1", 1.5), ("b/2", "b/2", 0.0)]


def test_matrix_files_of_any_form(spark, tmp_path, rows):
    (tmp_path / "m.csv").write_bytes(b',"x, ""y""",b\r\n"x, ""y""",0,1e-1\r\nb,NA,\r\n')
    assert rows(tables.read_distance_matrix(spark, str(tmp_path / "m.csv"))) == [("b", "b", None), ("b", 'x, "y"', None), ('x, "y"', "b", 0.1), ('x, "y"', 'x, "y"', 0.0)]
    (tmp_path / "wide.csv").write_text("," + ",".join(f"n{i}" for i in range(3000)) + "\n" + "".join(f"n{i}," + ",".join(str(i * j) for j in range(3000)) + "\n" for i in range(5)))
    wide = tables.read_distance_matrix(spark, str(tmp_path / "wide.csv"))
    assert wide.count() == 15_000 and wide.filter("a = 'n4' AND b = 'n2999'").first()["dist"] == 4 * 2999


def test_ledger_resumes(spark, tmp_path, rows):
    path, schema = str(tmp_path / "ledger"), "name string, rmse double"
    wanted = spark.createDataFrame([("a",), ("b",)], "name string")
    assert ledger.ledger_pending(wanted, ledger.ledger_read(spark, path, schema), ["name"]).count() == 2
    ledger.ledger_append(spark.createDataFrame([("a", 0.5)], schema), path)
    assert rows(ledger.ledger_pending(wanted, ledger.ledger_read(spark, path, schema), ["name"])) == [("b",)]


def test_links(spark, rows):
    html = '<A class="x" HREF="r1.pdf">1</A><a href=\'/top/r2.pdf\'>2</a><a href="https://o.org/r3.pdf">3</a><a href="../up/r4.pdf?x">4</a><a href="../r5.pdf">5</a><a href="//c.net/a&amp;b.pdf">6</a><p href="no.pdf">'
    pages = spark.createDataFrame([("http://h.org/a/b/page.html?q=1", html)], "url string, html string")
    assert [r["link"] for r in web.extract_links(pages).orderBy("position").collect()] == [
        "http://h.org/a/b/r1.pdf", "http://h.org/top/r2.pdf", "https://o.org/r3.pdf", "http://h.org/a/r5.pdf", "http://c.net/a&b.pdf"]


def test_odd_links(spark):
    deep = "a/" * 12 + "../" * 11
    html = f'<a href=plain.pdf>1</a><a href="{deep}r.pdf">2</a><a title=x href=\'it&#39;s&#x2F;q&quot;.pdf\'>3</a><a href="/./x/./y/../r.pdf">4</a><a href="../../../../r.pdf">5</a><a href="a&amp;lt;.pdf">6</a>'
    pages = spark.createDataFrame([("http://h.org/d/p.html", html), ("http://h.org", '<a href="r.pdf">'), (None, None)], "url string, html string")
    found = [r["link"] for r in web.extract_links(pages).orderBy(F.desc("url"), "position").collect()]
    assert found == ["http://h.org/d/plain.pdf", "http://h.org/d/a/r.pdf", "http://h.org/d/it's/q\".pdf", "http://h.org/x/r.pdf", "http://h.org/r.pdf", "http://h.org/d/a&lt;.pdf", "http://h.org/r.pdf"]


def test_periods(spark):
    names = {
        "Report_September2010.pdf": "2010-sep", "nimr-report-feb-2011-web.pdf": "2011-feb", "2014_sept_who.pdf": "2014-sep",
        "crick_annual.pdf": None, "Interim-2003-Aug.PDF": "2003-aug", "may__2016.pdf": "2016-may", "march------2016.pdf": None, "sept 12 2019 jun 2018.pdf": "2018-jun",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(web.report_period(F.col("n"))).collect()] == list(names.values())
