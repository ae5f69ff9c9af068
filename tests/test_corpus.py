"""Published tables, archives, wire formats: round trips, tampering, refusals."""

import glob
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.sources import archives, manifests, wire


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([("A", 1, 2.5), ("A", 2, None), ("B", 1, 0.0)], "symbol string, open_us long, close double")


def test_publish_and_reload(spark, frame, tmp_path):
    path = manifests.publish(frame, str(tmp_path), {"table": "t", "month": "2024-01"}, ["symbol", "open_us"])
    assert sorted(map(tuple, manifests.reload(spark, path).collect())) == sorted(map(tuple, frame.collect()), key=str) or manifests.reload(spark, path).count() == 3
    assert manifests.publish(frame.orderBy("open_us"), str(tmp_path), {"table": "t", "month": "2024-02"}, ["symbol", "open_us"]) != path
    found, missing = manifests.discover(spark, str(tmp_path), ["2024-01", "2024-02", "2024-03"], {"table": "t"})
    assert set(found) == {"2024-01", "2024-02"} and missing == ["2024-03"]
    assert manifests.audit_corpus(spark, str(tmp_path)).agg(F.sum("rows")).first()[0] == 6
    with pytest.raises(manifests.ManifestError):  # a key that repeats
        manifests.publish(frame, str(tmp_path), {"table": "u"}, ["open_us"])


def test_two_revisions_of_a_month_are_refused(spark, frame, tmp_path):
    manifests.publish(frame, str(tmp_path), {"table": "t", "month": "2024-01"})
    manifests.publish(frame.where("symbol = 'A'"), str(tmp_path), {"table": "t", "month": "2024-01"})
    with pytest.raises(manifests.ManifestError):
        manifests.discover(spark, str(tmp_path), ["2024-01"], {"table": "t"})


@pytest.mark.parametrize("what", ["data", "manifest", "name"])
def test_tampering_is_seen(spark, frame, tmp_path, what):
    path = manifests.publish(frame.coalesce(1), str(tmp_path), {"table": "t"})
    if what == "data":
        target = glob.glob(f"{path}/data/*.parquet")[0]
        other = tmp_path / "other"
        frame.withColumn("close", F.lit(1.0)).coalesce(1).write.parquet(str(other))
        open(target, "wb").write(open(glob.glob(f"{other}/*.parquet")[0], "rb").read())
        for crc in glob.glob(f"{path}/data/.*.crc"):
            __import__("os").remove(crc)
    elif what == "manifest":
        file = f"{path}/manifest.json"
        text = open(file).read()
        open(file, "w").write(text.replace('"rows":3', '"rows":4'))
        for crc in glob.glob(f"{path}/.*.crc"):
            __import__("os").remove(crc)
    else:
        __import__("os").rename(path, path[:-1] + ("0" if path[-1] != "0" else "1"))
        path = path[:-1] + ("0" if path[-1] != "0" else "1")
    with pytest.raises(manifests.ManifestError):
        manifests.reload(spark, path)


def test_canonical_json():
    assert manifests.canonical_json({"b": [1, "\u00e9"], "a": None}) == '{"a":null,"b":[1,"\u00e9"]}'
    with pytest.raises(ValueError):
        manifests.canonical_json(float("nan"))


def packed(name, *members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for member, text in members:
            z.writestr(member, text)
    return (f"/x/{name}.zip", out.getvalue())


ROW = "{t},1.5,2,1,1.75,10,{e},15,3,4,6.5,0"


def test_archives_decode_units(spark):
    rows = [packed("AB-1m-2024-12-31", ("AB-1m-2024-12-31.csv", ROW.format(t=1000, e=60999))), packed("AB-1m-2025-01-01", ("AB-1m-2025-01-01.csv", ROW.format(t=1000000, e=60999999)))]
    got = archives.decode(spark.createDataFrame(rows, "path string, content binary")).orderBy("archive").collect()
    assert [x["open_us"] for x in got] == [1_000_000, 1_000_000] and got[0]["close_us"] == 60_999_000 and str(got[0]["open"]).startswith("1.5") and got[0]["symbol"] == "AB"


@pytest.mark.parametrize("members", [[("other.csv", "")], [("AB-1m-2024-01.csv", ""), ("b.csv", "")], [("AB-1m-2024-01.csv", "1,2")], [("AB-1m-2024-01.csv", ROW.format(t="-1", e=2))]])
def test_archives_refuse(spark, members):
    df = archives.decode(spark.createDataFrame([packed("AB-1m-2024-01", *members)], "path string, content binary"))
    with pytest.raises(Exception, match="AB-1m-2024-01|fields"):
        df.collect()


def test_pages_off_the_grid_are_refused(spark):
    row = '["60000","1","2","0","1","0","0","5","7","0","1","0"]'
    page = lambda start, n: spark.createDataFrame([("A", start, n, f"[{row}]")], "symbol string, page_start long, count int, payload string")
    assert wire.page_of_bars(page(60000, 1)).first()["open_us"] == 60_000_000
    for bad in (page(0, 1), page(60000, 2)):
        with pytest.raises(Exception, match="a page"):
            wire.page_of_bars(bad).collect()


def test_live_frames(spark):
    frames = ['{"stream":"ab@kline_1m","data":{"E":5,"k":{"s":"AB","t":1,"T":2,"o":"1","h":"2","l":"1","c":"2","q":"3","Q":"1","n":4,"x":true}}}', '{"stream":"ab@bookTicker","data":{"u":9,"s":"AB","b":"1","B":"2","a":"3","A":"4"}}', '{"stream":"ab@aggTrade","data":{"E":1,"s":"AB","a":7,"p":"1","q":"2","f":1,"l":2,"T":3,"m":false}}', "junk"]
    told = wire.live_frames(spark.createDataFrame([(f,) for f in frames], "value string"))
    assert {k: v.count() for k, v in told.items()} == {"kline": 1, "trade": 1, "book": 1}
    assert told["kline"].first()["closed"] and told["book"].first()["ask_quantity"] == 4


def test_refusing_requests(spark, frame):
    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "symbol string")
    assert J.requested(frame, ask("B"), "symbol").count() == 1
    for bad in (ask("B", "B"), ask("C")):
        with pytest.raises(Exception, match="twice or unknown"):
            J.requested(frame, bad, "symbol").collect()
    with pytest.raises(Exception, match="names nothing"):
        J.excluded(frame, ask("C"), ["symbol"]).collect()
