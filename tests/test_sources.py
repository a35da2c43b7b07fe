"""Score and table readers on small inline samples."""

from pyspark.sql import functions as F

from quaverlake.sources import kern, tables

SCORE = "!!!COM: x\n**kern\t**kern\n*M3/4\t*M3/4\n=1\t=1\n4C\t4cc\n4D\t8dd\n.\t8ee\n=2\t=2\n[2E\t4r\n.\t4.ff#\n4E]\t8gg\n*-\t*-\n"


def test_parse():
    reason, num, den, notes = kern.parse(SCORE)
    assert (reason, num, den) == ("ok", 3, 4)
    low = [(n["start"], n["dur"], n["pitch"]) for n in notes if n["voice"] == 1]
    high = [(n["start"], n["dur"], n["pitch"]) for n in notes if n["voice"] == 0]
    assert low == [(0, 480, 48), (480, 480, 50), (960, 1440, 52)]
    assert high == [(0, 480, 72), (480, 240, 74), (720, 240, 76), (1440, 720, 78), (2160, 240, 79)]


def lines(*rows):
    return "!!!OTL: a score of some length for the test\n" + "\n".join(r.replace(" | ", "\t") for r in rows) + "\n"


def by_voice(text, **more):
    reason, _, _, notes = kern.parse(text, **more)
    assert reason == "ok", reason
    return {v: sorted((n["start"], n["dur"], n["pitch"]) for n in notes if n["voice"] == v) for v in {n["voice"] for n in notes}}


def test_splits_joins_and_exchanges_give_the_notes_of_the_unrolled_score():
    """The upper spine splits twice, its columns change places, a note is tied through a join; unrolled, each column is a spine of its own."""
    split = lines("**kern | **kern", "*M4/4 | *M4/4", "=1 | =1", "* | *^", "2C | 4cc | 2g", ". | 4dd | .", "* | *^ | *", "4D | 8ee | [8ff | 4a", ". | 8gg | 8ff] | .", "* | *x | *x | *", "4E | 4b- | 4aa | [4c", "* | *v | *v | *v", "4F | 4c]", "=2 | =2", "1G | 1cc", "*- | *-")
    plain = lines("**kern | **kern | **kern | **kern", "*M4/4 | *M4/4 | *M4/4 | *M4/4", "2C | 4cc | 2r | 2g", ". | 4dd | . | .", "4D | 8ee | [8ff | 4a", ". | 8gg | 8ff] | .", "4E | 4aa | 4b- | [4c", "4F | 4r | 4r | 4c]", "1G | 1cc | 1r | 1r", "*- | *- | *- | *-")
    got, want = by_voice(split), by_voice(plain)
    assert got[1] == want[3] and got[0] == sorted(want[0] + want[1] + want[2])


def test_spines_begin_and_end_and_others_are_passed_over():
    text = lines("**kern | **dynam | **kern", "4c | f | 4e", "* | *+ | *", "* | * | **kern | *", "4d | p | 4gg | 4f", "* | * | *- | *", "4e | . | 4g", "*- | *- | *-")
    got = by_voice(text)
    assert got == {2: [(0, 480, 60), (480, 480, 62), (960, 480, 64)], 1: [(0, 480, 64), (480, 480, 65), (960, 480, 67)], 0: [(480, 480, 79)]}
    assert kern.parse(lines("**kern | **kern", "4c | 4e", "4d", "*- | *-"))[0] == "error:Broken"
    assert kern.parse(lines("**kern | **kern", "4c | 4e", "* | *x", "*- | *-"))[0] == "error:Broken"


def test_lengths_and_names():
    assert [kern.length_of(x) * 480 for x in ("4c", "4.c", "4..c", "0c", "00c", "1%2c", "12c", "8qc", "c", "3%2c")] == [480, 720, 840, 3840, 7680, 3840, 160, 0, 0, 1280]
    assert [kern.pitch_of("4" + kern.name_of(p)) for p in range(24, 100)] == list(range(24, 100))
    assert [kern.pitch_of(x) for x in ("4b-", "4BB", "4r", "4ccc##")] == [70, 47, None, 86]


def test_reasons():
    assert kern.parse(None)[0] == "error_page" and kern.parse("<html>" + "x" * 40)[0] == "error_page"
    assert kern.parse(SCORE, most=1)[0] == "many_parts" and kern.parse("**kern\n4c\n" + "!" * 40)[0] == "few_parts" and kern.parse("!" * 40)[0] == "few_parts"
    assert kern.parse(lines("**kern | **kern", "4c | 4r", "*- | *-"))[0] == "few_voices"


def test_read_folder(spark, tmp_path):
    for name, text in (("bach/a.krn", SCORE), ("bach/b.krn", "<html>" + "x" * 40), ("_old/c.krn", SCORE), ("bach/a-auto.krn", SCORE), ("bach/d.krn", SCORE.replace("4D", "4D\t4D"))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    scores = kern.read_kern(spark, str(tmp_path))
    assert {(r.composer, r.reason, r.files) for r in kern.drop_reasons(scores).collect()} == {("bach", "ok", 1), ("bach", "error_page", 1), ("bach", "name", 1), ("bach", "error:Broken", 1)}
    assert kern.note_rows(scores).count() == 8


def test_tables(spark, tmp_path):
    seq = spark.createDataFrame([(1, "a", list(range(30))), (2, "b", [1])], tables.SEQUENCES)
    tables.write_sequences(seq, str(tmp_path / "s"))
    assert [r.seq_id for r in tables.read_sequences(spark, str(tmp_path / "s")).collect()] == [1]
    stats = tables.read_statistics(spark, None, {"a": 4})
    assert [r.p for r in stats.collect()] == [0.25] * 4
    texts = spark.createDataFrame([('{"perplexity":[5,25],"entropy":[2,5]}',), ('{"perplexity":[5]}',), ("x",)], "t string")
    assert [r.c is not None for r in texts.select(tables.parse_calibration("t").alias("c")).collect()] == [True, False, False]
    tables.write_runs([spark.range(1).select(F.lit(1).alias("a")), spark.range(1).select(F.lit(2).alias("b"))], str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["a", "b"]


def test_weights_reports_and_file_lists(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"other": 1,\n "weights_by_form": {"fugue": {"structural": 0.3, "recall": null}, "chorale": {}}}')
    w = tables.read_form_weights(spark, str(tmp_path / "w.json"))
    assert [tuple(r) for r in w.collect()] == [("fugue", "structural", 0.3)]
    assert tables.weights_for(w, {"x": 1.0}, "fugue") == {"structural": 0.3} and tables.weights_for(w, {"x": 1.0}, "motet") == {"x": 1.0}
    assert tables.read_form_weights(spark, None).count() == 0
    tables.write_report(spark.range(2).withColumn("name", F.lit("a,b")), str(tmp_path / "report"))
    assert [r.name for r in spark.read.option("header", True).csv(str(tmp_path / "report")).collect()] == ["a,b"] * 2
    for name in ("a.mid", "b.MIDI", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = tables.collect_files(spark, [f"{tmp_path}/*.*"], [f"{tmp_path}/a.mid", "/elsewhere/z.mid"])
    assert [r.path for r in got.collect()] == sorted([f"{tmp_path}/a.mid", f"{tmp_path}/b.MIDI", "/elsewhere/z.mid"])
    assert tables.collect_files(spark, []).count() == 0
