import random
import zlib

from staywise.llm import langid, queries
from tests.llm.helpers import clashing, docs_frame, documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in documents(spark, SF).collect()}
    got = queries.queries()["op10_langid"](spark, SF).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_read(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, SF)
    blind = docs.withColumn("lang", F.when(queries.remainder() == 2, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (langid.fit(d.where(queries.remainder() != 2), per_label=50) for d in (docs, blind))
    assert a.labels == b.labels and (a.table == b.table).all() and (a.limits == b.limits).all()


def test_edges(spark):
    model = langid.fit(documents(spark, SF), per_label=100)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the and of that"), (4, "the and of that"), (None, "der die und nicht"), (6, "the of and " * 200000)]
    got = langid.predict(clashing(docs_frame(spark, rows)), model).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and all(r["score"] == 0 for r in got[:3])
    assert [r["doc_id"] for r in langid.accepted(clashing(docs_frame(spark, rows)), model).collect()] == [4, 4, None, 6]
    blank = langid.train([], [])
    assert blank.predict(b"the") == ("und", 0.0) and blank.rejects(b"1") and not blank.rejects(b"the")
    assert got[3] == got[4] and got[3]["lang_pred"] == "en" and got[5]["doc_id"] is None and got[6]["lang_pred"] == "en"
    assert langid.predict(docs_frame(spark, []), model).collect() == []


def test_blocks_do_not_change_the_features(monkeypatch):
    m = langid.train([b"the and of", b"der die und", b"the that is", b"und nicht den"] * 5, ["en", "de"] * 10)
    long = b"the and of that is not a " * 500
    want = m.logits(long)
    monkeypatch.setattr(langid, "BLOCK", 1000)
    assert abs(m.logits(long) - want).max() < 0.05 * abs(want).max()


UNLEARNED = [  # the same sentences in languages that the documents do not hold
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в духе братства.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "يولد جميع الناس أحرارًا متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميرًا وعليهم أن يعامل بعضهم بعضًا بروح الإخاء.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, testvéri szellemben kell hogy viseltessenek."]


def test_unlearned_languages_are_rejected_and_clean_documents_stay(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    model = langid.fit(docs.where(queries.remainder() != 2))
    rng = random.Random(5)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n)) for n in (20, 40, 80, 200, 1000) for _ in range(40)]
    foreign = [model.rejects(t.encode()) for t in UNLEARNED]
    assert sum(foreign) == len(UNLEARNED)
    assert sum(model.rejects(t.encode()) for t in noise if langid.has_letter(t.encode())) >= 0.95 * len(noise)
    held = [r for r in docs.where(queries.remainder() == 2).where("text rlike '[a-zA-Z]'").collect()]
    assert not [r["doc_id"] for r in held if model.rejects(r["text"].encode())]
    assert 0.002 < model.temperature < 20
    rows = [(k, t) for k, t in enumerate(UNLEARNED)] + [(100 + r["doc_id"], r["text"]) for r in held[:50]]
    assert sorted(r["doc_id"] for r in langid.accepted(docs_frame(spark, rows), model).collect()) == sorted(100 + r["doc_id"] for r in held[:50])
