import random

from pyspark.sql import functions as F

from corpus_engine.operators import chunking as C


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_heading_paths(spark):
    text = "intro\n## A\nfirst\n### B\nsecond\n#### C\nthird\n### D\n\n  \n## E\nlast\n####### no heading\n## \nend"
    rows = C.split_sections(spark.createDataFrame([(1, text)], "page_id int, text string")).collect()
    assert [(r.section_no, r.heading_path, r.content) for r in rows] == [
        (0, None, "intro"),
        (1, "A", "first"),
        (2, "A > B", "second"),
        (3, "A > B > C", "third"),
        (4, "E", "last\n####### no heading\n## \nend"),
    ]


def test_level_jump_and_heading_only_pages(spark):
    df = spark.createDataFrame(
        [(1, "#### deep\nx\n### up\ny\n#### in\nz"), (2, "## only\n### headings"), (3, "  \n ")],
        "page_id int, text string",
    )
    rows = C.split_sections(df).orderBy("page_id", "section_no").collect()
    assert [(r.page_id, r.heading_path, r.content) for r in rows] == [
        (1, "deep", "x"),
        (1, "up", "y"),
        (1, "up > in", "z"),
        (2, None, "## only\n### headings"),
    ]


def test_marked_pairs(spark):
    two = "Q: What is it?\nA: A tool.\nFor work.\n\nq: Open question\nQ: And how?\nA: Like so."
    assert one(spark, two, C.marked_pairs) == [
        "Q: What is it?\nA: A tool.\nFor work.",
        "Q: Open question",
        "Q: And how?\nA: Like so.",
    ]
    assert one(spark, "Q: only one?\nA: yes", C.marked_pairs) == []


def test_question_lines(spark):
    text = (
        "lead\nWhat does it cost then?\nTen.\n\nA lot.\nShort one?\nWho can use it now?\nWhere is it kept?\nHere.\n"
        "When does it open up?\nAt nine."
    )
    assert one(spark, text, C.question_pairs) == [
        "Q: What does it cost then?\nA: Ten. A lot. Short one?",
        "Q: Where is it kept?\nA: Here.",
        "Q: When does it open up?\nA: At nine.",
    ]
    assert one(spark, text.split("When")[0], C.question_pairs) == []


def test_sentence_boundary(spark):
    def at(pos_of_stop):
        text = "x" * pos_of_stop + ". " + "y" * 4000
        return one(spark, text, lambda c: C.sentence_boundary(c, 2000))

    assert at(1500) == 1501
    assert at(1400) == 1401
    assert at(1399) == 2000
    assert one(spark, "z" * 3000, lambda c: C.sentence_boundary(c, 2000)) == 2000


def test_size_cut_without_sentence_end(spark):
    pieces = one(spark, "w" * 5000, C.split_by_size)
    assert [len(p) for p in pieces] == [2000, 3000]


def test_paragraph_packing(spark):
    a, b, c = "a" * 1500, "b" * 900, "c" * 100
    pieces = one(spark, f"{a}\n\n{b}\n\n\n{c}", C.split_by_size)
    assert pieces == [a, "a" * 200 + "\n\n" + b + "\n\n" + c]


def test_pieces_cover_the_text(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}." for _ in range(rng.randrange(200, 3000))]
        texts.append("".join(w + rng.choice([" ", " ", "\n\n"]) for w in words))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", C.split_by_size(F.col("text")).alias("p")).collect():
        assert set(" ".join(row.p).split()) == set(row.text.split()) or len(row.p[-1]) < 80 or min(map(len, row.p)) >= 80
        missing = set(row.text.split()) - set(" ".join(row.p).split())
        assert sum(map(len, missing)) < 80 * 2


def test_chunk_rows(spark):
    body = "This sentence is long enough to be kept as a chunk of its own, without any doubt at all."
    df = spark.createDataFrame([(7, "Title", f"## Part\n{body}\n## Tiny\nshort")], "page_id int, title string, text string")
    (row,) = C.chunk_pages(df, title=F.col("title")).collect()
    assert row.content == f"[Title > Part]\n\n{body}"
    assert (row.chunk_index, row.heading_path, row.snippet) == (0, "Part", body)
    assert row.token_count == -(-len(row.content) // 4)
