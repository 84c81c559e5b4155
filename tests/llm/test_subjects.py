import random

from seqloom.llm.subjects import sentences, subjects_of

DOCS = "doc_id bigint, text string, key string, subject string, total int"
EXAMPLES = "example_id bigint, subject string, lang string, text string"


def test_sentences():
    text = "Hello all!\n\n<p>The red fox, no. 12, met REF0012.</p><p>Zwei Füchse kamen?</p> - first item\n- second item &amp; more"
    assert sentences(text) == [["hello", "all"], ["the", "red", "fox", "no"], ["met"], ["zwei", "füchse", "kamen"], ["first", "item"], ["second", "item", "more"]]
    assert sentences(None) == sentences("") == sentences(" \n ") == []


def corpus(seed):
    rng = random.Random(seed)
    words = {s: [f"{s}{a}{b}" for a in "abcdef" for b in "uvwxyz"] for s in ("law", "sport", "ocean")}
    shared = ["the", "of", "and", "was", "with", "we", "noted", "that"]

    def sentence(s, n=18):
        return " ".join([*(w for x in rng.sample(words[s][:n], 4) for w in (rng.choice(shared), x))]).capitalize() + "."

    examples = [(i, s, "en", " ".join(sentence(s, 10) for _ in range(4))) for i, s in enumerate(["law", "sport", "ocean"] * 8)]
    docs, want = [], set()
    for i in range(400):
        main = rng.sample(list(words), rng.choice([1, 1, 2]))
        parts = [sentence(s, 36) for s in main for _ in range(8 // len(main))]
        if rng.random() < 0.3:  # a passing mention
            parts.append(sentence(rng.choice(list(words)), 36))
        parts += ["Noted that.", "We was the of."]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "k", "s", 1))
        want |= {(i, s) for s in main}
    docs += [(1000, None, "k", "s", 1), (1001, "", "k", "s", 1), (1002, "  \n", "k", "s", 1), (1003, "Noted that. We was.", "k", "s", 1), (1004, docs[0][1], "k", "s", 1), (None, docs[1][1], "k", "s", 1)]
    return examples, docs, want


def test_recovers_subjects(spark):
    examples, docs, want = corpus(1)
    areas = spark.createDataFrame([("law", "x"), ("sport", "x"), ("ocean", "x"), (None, "x")], "subject string, text string")
    got = subjects_of(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(examples, EXAMPLES), areas).collect()
    pairs = {(r.doc_id, r.subject) for r in got if r.doc_id is not None and r.doc_id < 1000}
    # most words are in no passage
    assert len(pairs & want) >= 0.9 * len(want)
    assert len(pairs & want) >= 0.97 * len(pairs)
    assert not {r.doc_id for r in got} & {1000, 1001, 1002, 1003}
    assert {r.subject for r in got if r.doc_id == 1004} == {r.subject for r in got if r.doc_id == 0}


def test_labelled_passages_held_out(spark, data):
    """Passages of one half start the topics, those of the other half are judged."""
    rows = spark.read.parquet(f"{data}/subject_examples.parquet").orderBy("example_id").collect()
    train, test = [r for i, r in enumerate(rows) if i % 2], [r for i, r in enumerate(rows) if not i % 2]
    docs = [(r.example_id, r.text) for r in test] + [(10_000 + i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect())]
    examples = spark.createDataFrame([(r.example_id, r.subject, r.lang, r.text) for r in train], EXAMPLES)
    got = subjects_of(spark.createDataFrame(docs, "doc_id bigint, text string"), examples, spark.read.parquet(f"{data}/subject_areas.parquet")).collect()
    found = {(r.doc_id, r.subject) for r in got if r.doc_id < 10_000}
    true = {(r.example_id, r.subject) for r in test}
    assert len(found & true) >= 0.9 * len(true)
    assert len(found & true) >= 0.9 * len(found)


def test_empty(spark):
    areas = spark.createDataFrame([("law",)], "subject string")
    examples = spark.createDataFrame([(1, "law", "en", "Courts and laws.")], EXAMPLES)
    assert subjects_of(spark.createDataFrame([], DOCS), examples, areas).collect() == []
    none = spark.createDataFrame([], EXAMPLES)
    assert subjects_of(spark.createDataFrame([(1, "Courts and laws.")], "doc_id bigint, text string"), none, areas).collect() == []
