import pytest
from pulsegrid.llm import sentences as S
from pyspark.sql import functions as F

DIFF = "diff --git a/x b/x\n+ a. B\n"


def units(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_char string, idx int")
    out = {i: [] for i in range(len(texts))}
    for r in S.found(df).orderBy("doc_id", "start_char").collect():
        out[r.doc_id].append(texts[r.doc_id][r.start_char : r.end_char])
    return out


CASES = [
    ("Fix the reader. Twice.\n\nIt was late. Dr. Vex saw no. 5 first.\nThat ended at 6 p.m. Details follow.\n", ["Fix the reader. Twice.", "It was late.", "Dr. Vex saw no. 5 first.", "That ended at 6 p.m.", "Details follow."]),
    ("wip\n\n* One item. And more\n  of it.\n* Two (see a. b.) here\n", ["wip", "One item.", "And more\n  of it.", "Two (see a. b.) here"]),
    ("s\n\nHe said \"Stop. Now.\" and left. (All of it. Yes.) Then «Ça va. Bien.» Fin.\n", ["s", 'He said "Stop. Now." and left.', "(All of it. Yes.)", "Then «Ça va. Bien.»", "Fin."]),
    ("s\n\nSigned-off-by: A. B <a@b.example>\n(cherry picked from commit 0123abcdef)\n---\n" + DIFF, ["s", "Signed-off-by: A. B <a@b.example>", "(cherry picked from commit 0123abcdef)"]),
    ("Merge branch 'a'\n\nConflicts:\n\tone/two.c\n\tthree.m\n", ["Merge branch 'a'", "Conflicts:", "one/two.c", "three.m"]),
    ("    indented\n    \n    First one. Second\n    one.\n    ```\n    not. Here.\n    ```\n", ["indented", "First one.", "Second\n    one."]),
    ("主题\r\n\r\n终于修好了！他说：“不行。绝对。”然后走了。 每次。\r\n", ["主题", "终于修好了！", "他说：“不行。绝对。”然后走了。", "每次。"]),
    ("α\n\nΓιατί το gap.fill; Τέλος! अब सब ठीक है। डॉ. वेक्स ने कहा। أخيرا؟ نعم. ስህተቱ። ሁለት። Սխալը։ Այժմ։\n", ["α", "Γιατί το gap.fill;", "Τέλος!", "अब सब ठीक है।", "डॉ. वेक्स ने कहा।", "أخيرا؟", "نعم.", "ስህተቱ።", "ሁለት።", "Սխալը։", "Այժմ։"]),
    (DIFF, []), ("", []), (None, []), (" \n\t\r\n", []), ("x", ["x"]), ("```\nx. Y\n", []), ("---\n", []),
]


def test_cases(spark):
    got = units(spark, [t for t, _ in CASES])
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, CASES[i][0]


def test_scripts_without_stops(spark):
    """Where sentences begin and end is learnt from single lines and holds at blanks and line breaks."""
    a, b, c = "เพิ่มการทดสอบ", "ฟังก์ชัน q_drop ถูกเรียกสองครั้ง", "ลบค่าตั้งเก่า"
    k, m = "시험 추가", "옛 설정 삭제"
    texts = [x + "\n" for x in (a, b, c, k, m)] * 30 + [f"{a}\n\n{b} {c} {a} {b}\n\n{k}\n{m}\n{m}\n{k}\n"]
    assert units(spark, texts)[150] == [a, b, c, a, b, k, m, m, k]


def test_held_out_accuracy(spark, sf_dir):
    """Joining known sentences by a blank and splitting them again finds nearly all of them."""
    import random

    rng = random.Random(2)
    known = ["The reader drops 5 rows.", "It went from 1.5 s to 2 s, i.e. a third less.", "Das kostet ca. 3 ms je Aufruf.", "Es war der 2. Versuch.", "Véase la pág. 12 del manual.", "См. рис. 6 и табл. 7.", "Is it safe?", "That's all.", "We keep the retries, etc.", "A. Vexholt and B. Haltune saw the same."]
    texts, want = [], []
    for _ in range(200):
        part = [rng.choice(known) for _ in range(rng.randint(1, 6))]
        texts.append("subject\n\n" + " ".join(part) + "\n")
        want.append(["subject", *part])
    got = units(spark, texts)
    right = sum(got[i] == w for i, w in enumerate(want))
    assert right >= 0.97 * len(want)


def test_long_text(spark):
    text = "s\n\n" + "One two three. " * 20000
    assert len(units(spark, [text])[0]) == 20001


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    df = spark.createDataFrame([(1, None)] * n, "doc_id long, text string")
    assert S.found(df).count() == 0


def test_learns_without_word_lists(spark):
    """With even chances for all cues, ends of blocks and words alone teach where sentences end in the documents."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    read = S.read_documents(docs)
    listed = {tuple(r) for r in S.split(read, S.fit(read)).collect()}
    learnt = {tuple(r) for r in S.split(read, S.fit(read, first=np.full(len(S.CUES), 0.5), prior=10.0)).collect()}
    rule = S.fit(read, rounds=1).select("id", "cues", "n", F.transform("cues", lambda c: F.element_at(F.lit(S.FIRST.tolist()), c + 1)).alias("chance"))
    ruled = {tuple(r) for r in S.split(read, rule).collect()}
    assert len(listed & learnt) >= 0.97 * len(listed | learnt)
    assert listed != ruled
    assert len(listed & ruled) >= 0.98 * len(listed | ruled)


def test_counts_meet_in_a_shuffle(spark, monkeypatch):
    """Tables over the bound give the same units: hot keys are sent, others meet in a shuffle."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    want = {tuple(r) for r in S.found(df).collect()}
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(S, "HOT", 50)
    assert {tuple(r) for r in S.found(df).collect()} == want
