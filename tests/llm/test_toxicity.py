import random
import zlib

from snapscope.llm import toxicity

from tests.llm.cases import documents, odd_texts, prose

BAD = "grobbel snarfit vileword".split()


def corpus(spark, n=500):
    r = random.Random(4)
    texts, toxic = [], []
    for k in range(n):
        words = prose(k, 60).split()
        toxic.append(int(k % 5 == 0))
        if toxic[-1]:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        texts.append(" ".join(words))
    return documents(spark, texts + odd_texts()), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"), toxic


def test_held_out_rows_are_told_apart(spark):
    docs, labels, toxic = corpus(spark)
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [i for i in range(len(toxic)) if got[i].held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = corpus(spark, 300)
    turned = labels.withColumn("toxic", (toxicity.remainder("doc_id") == 0).cast("int").bitwiseXOR(labels.toxic))
    a = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.scored(docs, turned).collect()}


def test_without_labels_and_without_documents(spark):
    docs, labels, _ = corpus(spark, 20)
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_hidden_and_shouted_words_are_features():
    lexicon = {"idiot": 4.0, "^idio": 3.0}
    plain, hidden = toxicity.lexicon_features("you idiot there", lexicon), toxicity.lexicon_features("you 1d10t there", lexicon)
    assert plain[0] == 4.0 and plain[6] > 0 and hidden[9] > 0 and toxicity.lexicon_features("", lexicon) == [0.0] * toxicity.N_FEATURES
    assert toxicity.lexicon_features("YOU THERE!!", lexicon)[7] > 0.8


def test_spelled_words_count_in_texts_of_any_length():
    line = "some plain words here and i d i o t sh*t there\n"
    below, above = (toxicity.lexicon_features(line * k, {"idiot": 4.0})[9] for k in (90_000 // len(line), 300_000 // len(line)))
    assert below == above == 2 / len(toxicity.tokens(line))
