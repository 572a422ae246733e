import random
import re

from snapscope.llm import decontaminate

from tests.llm.cases import documents, odd_texts, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, item in items:
        v = words(item)
        n = min(10, len(v))
        for window in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) == window:
                    hit |= set(range(at, at + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_agrees_with_brute_force(spark):
    r = random.Random(3)
    few = "a b c d e".split()
    items = [(k, " ".join(r.choice(few) for _ in range(r.randrange(1, 16)))) for k in range(12)] + [(20, prose(7, 30)), (21, prose(7, 30)), (22, "É ü!"), (23, ""), (24, None), (20, "Zed-zed")]
    texts = odd_texts() + [" ".join(r.choice(few) for _ in range(60)) for _ in range(15)] + [prose(8, 20) + " " + prose(7, 30).upper() + "; " + prose(9, 20), "é ü", "É Ü zed ZED", "a, b. C"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (decontaminate.BLOCK_WORDS, 40):
        sent = decontaminate.blocks(benchmark, block_words)
        got = documents(spark, texts).select("doc_id", decontaminate.found_in(sent).alias("f")).collect()
        for row in got:
            assert (row.f.n_words, row.f.n_hit, row.f["items"]) == brute(texts[row.doc_id], items), texts[row.doc_id]
    assert len(decontaminate.blocks(benchmark, 40)) > 1


def test_stage_leaves_no_window_and_keeps_clean_documents(spark):
    item = prose(7, 30)
    texts = ["before it " + prose(1, 100) + " " + item + " after", item, prose(2, 80), None, item[:30]]
    docs, benchmark = documents(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.decontaminated(docs, benchmark)
    kept = {r.doc_id: r for r in out.collect()}
    assert sorted(kept) == [0, 2, 3, 4] and out.columns == docs.columns
    assert kept[0].text == "before it " + prose(1, 100) + " after" and kept[2].text == texts[2] and kept[3].text is None
    assert not decontaminate.report(out, benchmark).where("contaminated").count()


def test_empty_tables(spark):
    docs = documents(spark, ["some text"])
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.report(docs, none).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert decontaminate.report(docs.limit(0), none).count() == 0
