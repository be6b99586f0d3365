"""Cases in which operators once went wrong."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tallygrove.llm import pii, quality_classifier, warc

from test_operators import plain_digits


def test_one_labelled_id_in_very_many_rows(spark):
    docs = spark.range(30_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(5, "another text"), (6, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, 0), (6, 1)] * 50, "doc_id long, quality int")
    x, y, _ = quality_classifier.sample(docs, labels, sample_rows=3)
    assert len(x) == len(y) <= 3
    again = quality_classifier.sample(docs.repartition(7), labels, sample_rows=3)
    assert np.array_equal(x, again[0]) and np.array_equal(y, again[1])


def test_column_is_the_rules_in_numpy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, labels)
    rows = quality_classifier.score(quality_classifier.statistics(docs.select("doc_id", "text")), model, score_name="score").select("score", "_tg_stats.*").toPandas()
    x = rows[list(quality_classifier.STATS)].to_numpy()
    total = model.bias + sum(w * quality_classifier._holds(x, path) for path, w in model.rules)
    assert len(model.rules) > 5 and np.allclose(rows.score, 1 / (1 + np.exp(-total)), rtol=0, atol=1e-12)


def test_dates_share_a_pseudonym_only_if_they_name_one_day(spark):
    """All days from 1900 to 2099 day-first, month-first and in ISO form."""
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int"))
    forms = F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "MM/dd/yyyy"))
    said = spark.range(17 * 4297).select(F.explode(forms).alias("x")).distinct().select("x", pii._date(F.col("x"), "k").alias("y"))
    # A date that can be read day-first is.
    plain = lambda c: F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd/MM/yyyy"), F.try_to_date(c, "MM/dd/yyyy"))
    rows = said.select("x", "y", plain(F.col("x")).alias("day"), plain(F.col("y")).alias("new"))
    assert rows.where("y is null or new is null or y = x and false").count() == 0
    assert rows.groupBy("y").agg(F.countDistinct("day").alias("n")).where("n > 1").count() == 0
    days = rows.groupBy("day").agg(F.countDistinct("new").alias("n"), F.min("new").alias("new"))
    assert days.where("n > 1").count() == 0 and days.select("new").distinct().count() == days.count() == 17 * 4297


def test_ibans_mails_and_phones_against_a_plain_feistel(spark, docs_of):
    def turned(ch, by):
        for one in pii._SETS:
            if ch in one:
                return one[(one.index(ch) + by) % len(one)]
        return ch

    def mail(x):
        local, domain = x.split("@")
        a, b = local[: len(local) // 2], local[len(local) // 2 :]
        said = lambda i, k, other: int(hashlib.sha256(f"k|mail|{i}|{k}|{other}".encode()).hexdigest()[:15], 16)
        for i in range(pii.ROUNDS):
            if i % 2 == 0:
                a = "".join(turned(c, said(i, k, b)) for k, c in enumerate(a))
            else:
                b = "".join(turned(c, said(i, k, a)) for k, c in enumerate(b))
        return f"{a}{b}@{domain}"

    def filled(x, digits):
        rest = iter(digits)
        return "".join(next(rest) if c.isdigit() else c for c in x)

    def iban(x):
        p = x.replace(" ", "")
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        if number(p[4:] + p[:4]) % 97 != 1:
            return None
        account = filled(p[4:], plain_digits(re.sub("[^0-9]", "", p[4:]), "k", "iban"))
        new = iter(f"{p[:2]}{98 - number(account + p[:2] + '00') % 97:02}{account}")
        return "".join(" " if c == " " else next(new) for c in x)

    def phone(x):
        d = re.sub("[^0-9]", "", x)
        code = len(re.match(f"(?:{pii._DIAL})", d)[0]) if x.startswith("+") else 0
        return filled(x, d[:code] + plain_digits(d[code:], "k", "phone"))

    mails = ["jo.doe7@mail.example.com", "a@b.org", "Ab_9%+-x@x-y.co.uk", "..@d.net", "zZ0@q.io", "long.local.part.0123456789@host.example"]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606", "DE89 3704 0044 0532 0130 01"]
    phones = ["+49 170 1234567", "+1 (212) 555-0147", "(212) 555-0147", "212-555-0147", "+353 87 123 4567", "+7 495 123-45-67"]
    values = [*mails, *ibans, *phones]
    got = spark.createDataFrame([(x,) for x in values], "x string").select("x", pii._kind(F.col("x")).alias("k")).withColumn("y", pii._pseudonym(F.col("k"), F.col("x"), "k")).collect()
    assert {r.k for r in got} == {"mail", "iban", "phone"}
    for r in got:
        assert r.y == {"mail": mail, "iban": iban, "phone": phone}[r.k](r.x), r.x


def record(kind, ident, block, *more, size=None):
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", "WARC-Date: 2020-02-02T02:02:02Z", *more, f"content-length: {len(block) if size is None else size}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_from_files_of_another_hand_to_derivatives(spark, tmp_path):
    http = lambda body, *head: "\r\n".join(["HTTP/1.1 203 Partly", *head]).encode() + b"\r\n\r\n" + body
    nested = record("response", "inner", http(b"<p>inner</p>"))
    data = {
        "a.warc": record("warcinfo", "w", b"software: other\r\n") + record("response", "1", http("<title>T &amp; U</title><p>é one".encode(), "X-Own: 7", "Server: s"), "WARC-Target-URI: http://a/1", "WARC-Payload-Digest: sha1:ABC")
        + record("response", "2", http(b"see\r\n\r\n" + nested + b"<a href=/z>end</a>")) + record("request", "3", b"GET / HTTP/1.1\r\n\r\n") + record("response", "4", b"HTTP/1.1 204 None"),
        "b.warc": record("response", "5", http(b"<p>damaged"), size=100_000) + record("response", "6", http(b"holds WARC/1.1\r\nContent-Length: 99999\r\n\r\nx<br>y")) + record("response", "7", http(b"last")) + record("response", "8", http(b"torn"), size=77)[:-4],
    }
    for name, content in data.items():
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    records = warc.read_files(spark, f"{tmp_path}/in")
    whole = {r.record_id[10:-1]: r for r in records.where("whole").collect()}
    assert set(whole) == {"w", "1", "2", "3", "4", "6", "7"} and {r.record_id[10:-1] for r in records.where("not whole").collect()} == {"5", "8"}
    assert whole["2"].block.encode() == http(b"see\r\n\r\n" + nested + b"<a href=/z>end</a>")
    made = {(r.refers_to[10:-1], r.warc_type): r for r in warc.derive(records).collect()}
    assert set(made) == {(i, t) for i in "12467" for t in ("metadata", "conversion")}
    one = made["1", "metadata"]
    assert one.block == "source-status: HTTP/1.1 203 Partly\r\nsource-header: X-Own: 7\r\nsource-header: Server: s\r\nsource-payload-digest: sha1:ABC\r\ntitle: T & U\r\nlanguage: \r\n"
    assert (one.target_uri, one.date, one.payload_digest) == ("http://a/1", "2020-02-02T02:02:02Z", "sha1:ABC") and made["1", "conversion"].block == "é one"
    assert made["2", "metadata"].payload_digest == "sha256:" + hashlib.sha256(b"see\r\n\r\n" + nested + b"<a href=/z>end</a>").hexdigest() and "outlink: /z\r\n" in made["2", "metadata"].block
    assert made["6", "conversion"].block.endswith("x\ny") and made["4", "conversion"].block == ""
    warc.convert_files(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    back = {(r.refers_to[10:-1], r.warc_type): r for r in warc.read_files(spark, f"{tmp_path}/out").collect()}
    assert set(back) == set(made) and all(back[k].block == made[k].block and back[k].record_id == made[k].record_id and back[k].whole for k in made)


def test_records_survive_any_split(spark, tmp_path):
    """Files read by many tasks: only a record that a split's end cuts at a version line inside is marked, none is lost or made up."""
    rows = b"".join(record("response", f"n{k}", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * (k * 37 % 900)) for k in range(300))
    (tmp_path / "c.warc").write_bytes(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = warc.read_files(spark, f"{tmp_path}/c.warc")
        assert got.rdd.getNumPartitions() > 3
        assert {r.record_id[10:-1]: r.whole for r in got.collect()} == {f"n{k}": True for k in range(300)} and got.count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
