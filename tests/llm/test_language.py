import numpy as np
import pytest
from tidelog.llm.language import Classifier, document_languages, label_of, language_segments, mislabelled, scored, sentences

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{DATA}/lang_samples.parquet")


def test_labels():
    for name, code in {"en_US": "en", "English": "en", "pt-BR": "pt", "ger": "de", " FR ": "fr", "xx": None, "": None, None: None, "??": None, "und": None, "nld": "nl", "Brazilian Portuguese": "pt", "zh-DE": None, "русский": "ru"}.items():
        assert label_of(name) == code


def test_held_out_samples(samples):
    rows = samples.orderBy("sample_id").collect()
    c = Classifier([(r["lang"], r["text"]) for r in rows if r["sample_id"] % 2])
    held = [r for r in rows if not r["sample_id"] % 2]
    s = scored(c, [r["text"] for r in held])
    assert np.mean([c.codes[k] == r["lang"] for k, r in zip(s.argmax(axis=1), held)]) > 0.97


def test_sentences_are_prose():
    text = "== The heading of this part. ==\n{{Box|This is not a sentence here.}}\nThe old [[mill|mill house]] burned down in 1901.<ref>See the book of Smith.</ref> Short one.\n{|\n| A cell that has a whole sentence.\n|}\n#REDIRECT [[The other page of this]].\n[[Category:A thing of that kind.]]"
    assert sentences(text) == ["The old mill house burned down in 1901."]


EN = "The old harbour supplied most of the salt trade when the mine was closed. It was not rebuilt after the storm, although the owners had asked for it twice."
DE = "Nach dem Sturm wurde sie nicht wieder aufgebaut, obwohl die Besitzer zweimal darum gebeten hatten. Heute befinden sich in dem Gebäude eine Schule und das Archiv."


def test_documents(spark, samples):
    docs = {1: (EN, "en"), 2: (EN, "English"), 3: (EN, "de"), 4: (EN + "\n\n" + DE, "en"), 5: (DE, None), 6: (None, "en"), 7: ("", "de"), 8: ("{{x}} == Y ==", "fr"), 9: ("qzx wvk jjq ptlk zzx qqw. vvk bnm qpw xxz wqk ppl.", "en"), 10: (EN + " (" + DE[:40] + ")", "en"), 11: ((EN + " ") * 500, "en_GB")}
    df = spark.createDataFrame([(k, *v, 0.5) for k, v in docs.items()], "doc_id long, text string, lang string, confidence double")
    found = language_segments(df, samples)
    assert sorted((r["doc_id"], r["lang"]) for r in mislabelled(found).collect()) == [(3, "en"), (4, "de"), (4, "en"), (5, "de")]
    langs = {r["doc_id"]: r for r in document_languages(found).collect()}
    assert langs[4]["mixed"] and langs[1]["lang"] == "en" and langs[1]["confidence"] > 0.99 and langs[6]["lang"] is None and langs[9]["lang"] is None
    seg = {r["doc_id"]: r["segments"] for r in found.collect()}
    assert [(s["lang"], s["first"], s["last"]) for s in seg[4]] == [("en", 0, 1), ("de", 2, 3)]
    assert language_segments(df.limit(0), samples).count() == 0
    assert language_segments(df, samples.limit(0)).where("size(segments) > 0").count() == 0


def test_segments_lead_back_to_the_text(spark):
    samples = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet")
    text = {r["lang"]: r["text"] for r in samples.where("sample_id % 30 < 8").collect()}
    de, fr = text["de"], text["fr"]
    raw = "{{Box|name=x}}\n== Kopf ==\n" + de + "\n\n{|\n| a || b\n|}\n" + fr
    docs = spark.createDataFrame([(1, raw, "de"), (2, "== Kopf ==\n* der Hafen und die Fischer von der Insel im Norden", "de"), (3, None, "de"), (4, "", None), (5, "qx zv wk", None)], "doc_id long, text string, lang string")
    found = language_segments(docs, samples, places=True, whole=True)
    got = {r["doc_id"]: r for r in found.collect()}
    parts = {s["lang"]: raw[s["start"] : s["end"]] for s in got[1]["segments"]}
    assert parts.keys() == {"de", "fr"} and parts["de"].rstrip(".!?") in de and parts["fr"].rstrip(".!?") in fr and min(map(len, parts.values())) > 20
    languages = {r["doc_id"]: r for r in document_languages(found).collect()}
    assert languages[2]["lang"] == "de" and not languages[2]["has_prose"] and languages[1]["mixed"] and languages[3]["lang"] is languages[4]["lang"] is languages[5]["lang"] is None
