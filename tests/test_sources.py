"""Readers and writers on small files."""

from quillon.sources import corpus as C

PAGE = """# bio page
<f1r>      <! $Q=A $L=A $H=1>
<f1r.1,@P0>       fachys.ykal,ar<->ataiin
<f1r.2,+P0>       sory.ch!ol[k:t]y.%bad
# herbal-b
<f1r.3,@Lz>       otal
"""


def test_ivtff(spark, tmp_path):
    (tmp_path / "f1r.txt").write_text(PAGE)
    rows = C.read_ivtff(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.locus, r.locus_type, r.section, r.currier, r.words) for r in rows] == [
        ("f1r.1,@P0", "P", "bio", "A", ["fachys", "ykal", "ar", "ataiin"]),
        ("f1r.2,+P0", "P", "bio", "A", ["sory", "cholky"]),
        ("f1r.3,@Lz", "L", "herbal-B", "A", ["otal"]),
    ]
    assert C.read_ivtff(spark, str(tmp_path), locus_types=("L",)).count() == 1
    assert C.read_ivtff(spark, str(tmp_path), comma_break=False, least=4).orderBy("line_no").first().words == ["fachys", "ykalar", "ataiin"]


def test_generic_alphabet(spark, tmp_path):
    (tmp_path / "x.txt").write_text("<f1.1,@P0> 4oh@152;9.2oe?.{1}c9\n")
    assert C.read_ivtff(spark, str(tmp_path), generic=True).first().words == ["4oh@152;9", "1c9"]


def test_prose_control_boxes(spark, tmp_path):
    (tmp_path / "p.txt").write_text("﻿head *** START *** Ein Wört, zwei *** END *** tail")
    assert C.read_prose(spark, str(tmp_path / "p.txt"), "START ***", "*** END").first().words == ["ein", "wört", "zwei"]
    (tmp_path / "c.txt").write_text("a b c d e\na b\n")
    assert [r.words for r in C.read_control(spark, str(tmp_path / "c.txt")).collect()] == [["a", "b", "c", "d", "e"]]
    (tmp_path / "b.xml").write_text('<page><word index="0" x="1" y="2" width="3" height="4">rotaiin</word></page>')
    assert tuple(C.read_boxes(spark, str(tmp_path / "b.xml")).first()) == (0, 1, 2, 3, 4, "rotaiin")


def test_write_corpus_and_results(spark, tmp_path):
    lines = spark.createDataFrame([("c", 0, 0, ["a", "b"]), ("c", 0, 1, ["a"]), ("d", 1, 0, ["x"])], "corpus string, doc_id long, line_no long, words array<string>")
    m = C.write_corpus(lines, str(tmp_path / "out")).collect()
    assert sorted(map(tuple, m)) == [("c", 3, 2, 2), ("d", 1, 1, 1)]
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted((r.corpus, r.value) for r in back.collect()) == [("c", "a"), ("c", "a b"), ("d", "x")]
    (tmp_path / "r.json").write_text('{"gate": true, "verdict": "bind"}')
    assert tuple(C.read_results(spark, str(tmp_path / "r.json"), "gate boolean, verdict string").first()) == (True, "bind")


def test_marks_edition_labels(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# no @1;\n<f1.1,@Cc> ab@152;c{de}f'@152;\n<f1.2,@P0> x\n")
    assert sorted(map(tuple, C.read_marks(spark, str(tmp_path / "m.txt")).drop("file").collect())) == [("'", 1), ("@152;", 2), ("{de}", 1)]
    assert [r.locus for r in C.labels(C.read_ivtff(spark, str(tmp_path / "m.txt")), ("P0",)).collect()] == ["f1.2,@P0"]
    (tmp_path / "e.txt").write_text("Incipit liber 3\npreface words here\nIncipit liber\n12\nprima linea textus\n1 a footnote\nsecunda om. cod. linea\nsolus\ntertia linea\n")
    got = C.read_edition(spark, str(tmp_path / "e.txt"), "incipit liber").orderBy("line_no").collect()
    assert [r.words for r in got] == [["incipit", "liber"], ["prima", "linea", "textus"], ["tertia", "linea"]]
