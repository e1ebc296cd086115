import random

from tarsus.llm import decontam


def test_blocks_of_items_give_the_rows_of_one_index(spark):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(120)]
    prose = lambda n: " ".join(r.choice(vocab[: r.choice((8, 120))]) for _ in range(n))
    items = [(i, prose(r.randrange(6, 90)), None if i % 7 == 0 else prose(r.randrange(1, 9))) for i in range(40)] + [(40, None, None), (41, "", "?")]
    docs = []
    for i in range(80):
        w = items[i % 40][1].split()
        kept = " ".join(x for x in w if r.random() < 0.9) if i % 2 else " ".join(w[: len(w) * 2 // 3])  # scores on both sides of the threshold
        docs.append((i, f"{prose(r.randrange(0, 200))} {kept} {items[i % 40][2] or ''} {prose(r.randrange(0, 100))}"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(items, "item_id long, text string, answer string")
    for answer in (None, "answer"):
        rows = lambda n: sorted(map(tuple, decontam.contaminated(d, t, answer_col=answer, indexed=n).drop("text_hash").collect()))  # noqa: E731, B023
        assert len(want := rows(100)) > 20
        assert rows(15) == rows(5) == want


def test_short_questions_and_answers(spark):
    docs = spark.createDataFrame([(1, "so alpha, and on and on"), (2, "it is Beta gamma here"), (3, "gamma beta is not it"), (4, "one two three at last"), (5, "what is the capital of France? It is Paris")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "alpha"), (11, "beta gamma"), (12, "one two three")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(1, 10), (2, 11), (4, 12)]
    items = spark.createDataFrame([(20, "What is the capital of France", "Paris"), (21, "What is the capital of France", "Lyon")], "item_id long, text string, answer string")
    assert [(r.doc_id, r.item_id, r.answer_overlap) for r in decontam.contaminated(docs, items, answer_col="answer").collect()] == [(5, 20, 1.0)]
