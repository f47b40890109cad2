from pyspark.sql import functions as F

from tracewright.operators.packed import split_packed

SCHEMA = "id long, options array<string>, pos string"


def run(spark, *options, only=True):
    df = spark.createDataFrame([(i, o, "x") for i, o in enumerate(options)], SCHEMA)
    out = {}
    for r in split_packed(df, "id", "options", only).orderBy("id", "pos").collect():
        out.setdefault(r[0], []).append(r[2])
    return [out.get(i, []) for i in range(len(options))]


def test_labelled_delimiters(spark):
    got = run(
        spark,
        ["A. red; B. blue and/or x, y | C. green"],
        ["- (A) one\r\n- (B) two; nobody\r\n- (C) three"],
        ["A. one", "B. two；C. three", "D. The sign says \"a, B. b\""],
        ["A. 14 of them,\"B. waits, then leaves\",C. x"],
        ["A. by J. Smith, B. Jones"],
    )
    assert got[0] == ["A. red", "B. blue and/or x, y", "C. green"]
    assert got[1] == ["(A) one", "(B) two; nobody", "(C) three"]
    assert got[2] == ["A. one", "B. two", "C. three", "D. The sign says \"a, B. b\""]
    assert got[3] == ["A. 14 of them", "B. waits, then leaves", "C. x"]
    assert got[4] == ["A. by J. Smith", "B. Jones"]


def test_label_sequence_must_continue(spark):
    assert run(spark, ["A. met T. Hall, H. Low", "B. none"]) == [[]]


def test_lists_and_csv(spark):
    got = run(
        spark,
        ["['A. it', \"B. the helper's\"]"],
        ['["The sign says \\"x, y\\"", "Nothing"]'],
        ['"The sign says ""x""",Nothing changes,"By a, not b"'],
        ["in the rain | both of them, left / no one"],
        ["One thing | Another | A third, Fourth; nobody"],
    )
    assert got[0] == ["A. it", "B. the helper's"]
    assert got[1] == ['The sign says "x, y"', "Nothing"]
    assert got[2] == ['The sign says "x"', "Nothing changes", "By a, not b"]
    assert got[3] == ["in the rain", "both of them", "left", "no one"]
    assert got[4] == ["One thing", "Another", "A third", "Fourth; nobody"]


def test_quoted_neighbours(spark):
    got = run(
        spark,
        ['"before noon","at dawn"; "three"'],
        ['A) Because,B) None,"D) By a, not b","E) By c, not d"'],
        ['A) Because,B) None,"C) By a, not b","D) By c, not d"'],
        ['"The cat waits, then leaves",A jar and/or a kettle,"By a, not b"'],
        ['"The sign says ""x y""" | The cat waits, then leaves'],
    )
    assert got[0] == ["before noon", "at dawn", "three"]
    assert got[1][:1] == ["A) Because"] and len(got[1]) == 2
    assert got[2] == ["A) Because", "B) None", "C) By a, not b", "D) By c, not d"]
    assert got[3] == ["The cat waits, then leaves", "A jar and/or a kettle", "By a, not b"]
    assert got[4] == ['The sign says "x y"', "The cat waits, then leaves"]


def test_edges(spark):
    got = run(spark, None, [], [None, ""], ["A. one", "B. two"], [None, "A. one\nB. two", " "], ["A. " + "x" * 200_000 + "; B. y"])
    assert got[:4] == [[], [], [], []]
    assert got[4] == ["A. one", "B. two"]
    assert [len(v) for v in got[5]] == [200_003, 4]
    assert run(spark, ["A. one", "B. two"], only=False) == [["A. one", "B. two"]]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, ["A. x; B. y"], "p")] * 2, SCHEMA)
    assert split_packed(df, "id", "options").count() == 4
    assert split_packed(df.where(F.lit(False)), "id", "options").count() == 0
