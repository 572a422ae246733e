from snapscope.llm import language

from tests.llm.cases import documents

TEXTS = {"en": "the cat sat on the mat and then the dog came with the other one", "fr": "le chat est sur la table et le chien vient avec les autres dans la maison", "de": "die katze sitzt auf der matte und dann kam der hund mit dem anderen"}


def page(text, lang=""):
    return f"<html{f' lang={lang}' if lang else ''}><body><article><p>{text}</p></article></body></html>"


def run(spark, rows, docs=None):
    train = documents(spark, [TEXTS["en"]] * 3, lang="en").union(documents(spark, [TEXTS["fr"]] * 3, lang="fr")).union(documents(spark, [TEXTS["de"], None, ""], lang="de"))
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, guess int")
    return {r.page_id: r for r in language.identify(pages, train if docs is None else docs).collect()}


def test_text_decides_where_there_is_enough_of_it(spark):
    got = run(spark, [(k, f"http://h{k}.example.org/", page(TEXTS[lang], "en")) for k, lang in enumerate(TEXTS)])
    assert [got[k].lang for k in range(3)] == list(TEXTS)


def test_host_and_declaration_decide_for_pages_without_text(spark):
    rows = [(k, "http://x.example.fr/", page(TEXTS["fr"], "fr")) for k in range(30)] + [(k, "http://y.example.de/", page(TEXTS["de"], "de")) for k in range(30, 60)]
    rows += [(100, "http://x.example.fr/", None), (101, "http://y.example.de/", ""), (102, "http://new.example.org/", page("", "de")), (103, None, None), (103, None, None)]
    got = run(spark, rows)
    assert (got[100].lang, got[101].lang, got[102].lang) == ("fr", "de", "de") and got[100].text_lang is None
    assert got[103].lang in TEXTS and 0 < got[103].confidence <= 1


def test_empty_tables_and_long_pages(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, "u", page(TEXTS["en"] * 20_000))])[1].lang == "en"
    assert run(spark, [(1, "u", page("x"))], documents(spark, []))[1].lang is None


def test_the_rarest_of_many_languages_is_known(spark):
    texts = [f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} {chr(0x6E00 + k)}" * 9 for k in range(205)]
    docs = documents(spark, [TEXTS["de"]], lang="de")
    docs = docs.union(spark.createDataFrame([(k, t, f"x{k % 205:03}") for k, t in enumerate(texts * 2)], "doc_id long, text string, lang string").selectExpr(
        "doc_id", "text", "lang", *(f"CAST(NULL AS {t})" for _, t in docs.dtypes[3:])))
    got = run(spark, [(1, "http://a.example.org/", page(TEXTS["de"])), (2, "http://b.example.org/", page(texts[204])), (3, "http://b.example.org/", page(""))], docs)
    assert (got[1].lang, got[2].lang, got[1].text_lang, got[2].text_lang) == ("de", "x204", "de", "x204") and got[3].text_lang is None


def test_blocks_of_languages_change_nothing(spark, monkeypatch):
    rows = [(k, f"http://h{k % 4}.example.fr/", page(TEXTS[lang], lang)) for k, lang in enumerate([*TEXTS] * 3)] + [(50, None, None)]
    one = run(spark, rows)
    monkeypatch.setattr(language, "LANGUAGE_BLOCK", 1)
    several = run(spark, rows)
    assert all((one[k].lang, one[k].text_lang) == (several[k].lang, several[k].text_lang) and abs(one[k].confidence - several[k].confidence) < 1e-9 for k in one)
