"""Edge values of the catalogue's rules."""

import dataclasses
import math
import os
import random
import re
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from framelake.functions import exprs as X
from framelake.operators import audio, config, crop, encoding, events, hdr, listing, numbering, options, probe, progress, results, validation
from framelake.plans import catalogue_encode, catalogue_events, registry
from framelake.plans.relations import relation
from framelake.sources import documents, facts, files, tables

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("spec", "want"), [("27", (27, 27, 27)), (" 25 , 27 ,\t29\n", (25, 27, 29)), ("0", (0, 0, 0)), ("63", (63, 63, 63)), ("64", None), ("-1", None), ("+5", None), ("25,27", None), ("1,2,3,4", None), ("a", None), ("", None), ("1,,3", None), ("007", (7, 7, 7)), ("2 7", None)])
def test_crf_specs(spark, spec, want):
    got = value(spark, config.parse_crf(F.lit(spec)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("width", "want"), [(1919, "SD"), (1920, "HD"), (3839, "HD"), (3840, "UHD"), (0, "SD")])
def test_bands(spark, width, want):
    assert value(spark, X.band(F.lit(width))) == want
    probe = spark.createDataFrame([(1, width)], "file_id bigint, width int")
    assert config.crf_by_band(probe, config.band_table(spark, "quick")).first()["crf"] == {"SD": 32, "HD": 35, "UHD": 36}[want]


def decide(spark, width, height, crops):
    samples = spark.createDataFrame([(1, i, width, height, c) for i, c in enumerate(crops)], "file_id bigint, sample_no int, width int, height int, crop string")
    return crop.decisions(samples).first()


def test_crop_decisions(spark):
    same = decide(spark, 1920, 1080, ["1920:800:0:140"] * 5)
    assert (same["crop_filter"], same["required"], same["total_samples"]) == ("crop=1920:800:0:140", True, 5)
    jitter = decide(spark, 1920, 1080, ["1920:1040:0:20", "1920:1036:0:22", "1920:1044:0:18", "1920:1040:0:21", "400:200:700:400", "1920:1041:0:17"])
    assert jitter["crop_filter"] == "crop=1920:1046:0:16"
    mixed = decide(spark, 1920, 1080, ["1920:800:0:140", "1920:1080:0:0", "bad"])
    assert (mixed["crop_filter"], mixed["multiple_ratios"], mixed["message"]) == ("", True, "Multiple aspect ratios detected")
    full = decide(spark, 1920, 1080, ["1920:1080:0:0"] * 2)
    assert (full["multiple_ratios"], full["message"]) == (False, "Analyzed 141 samples")
    odd = decide(spark, 1919, 1080, ["1919:800:0:140"])
    assert (odd["required"], odd["multiple_ratios"]) == (False, False)
    wrong = decide(spark, 1920, 1080, ["1921:800:0:0", "x:1:2", "1920:800:0", "1920:800:0:4294967296", "+1:2:3:4", "1920:1080:0:1"])
    assert (wrong["required"], wrong["total_samples"]) == (False, 6)
    assert decide(spark, 100, 100, ["0:100:100:0"])["required"] is False
    probe = spark.createDataFrame([(1, 10, 10), (2, 10, 10)], "file_id bigint, width int, height int")
    none = spark.createDataFrame([], "file_id bigint, sample_no int, width int, height int, crop string")
    assert {tuple(r) for r in crop.decide_all(probe, none).collect()} == {(i, "", False, False, "Analyzed 141 samples", 141) for i in (1, 2)}
    assert {tuple(r) for r in crop.decide_all(probe, none, disabled=True).collect()} == {(i, "", False, False, "Skipped", 0) for i in (1, 2)}


def test_ten_candidates_have_a_remainder_of_none(spark):
    for n, want in ((9, []), (10, [0]), (13, [3])):
        rows = [(1, i, 100, 100, f"{i}:1:0:0") for i in range(n)]
        top = crop.top_candidates(spark.createDataFrame(rows, "file_id bigint, sample_no int, width int, height int, crop string"))
        assert [r["remainder"] for r in top.collect() if r["remainder"] is not None] == want


@pytest.mark.parametrize(("x", "digits", "want"), [(0.25, 1, "0.2"), (0.35, 1, "0.3"), (1.005, 2, "1.00"), (2.5, 0, "2"), (3.5, 0, "4"), (1e6, 2, "1000000.00"), (-0.04, 1, "-0.0")])
def test_rounding_is_that_of_printf(spark, x, digits, want):
    assert want == f"{x:.{digits}f}" and value(spark, X.fixed(F.lit(x), digits)) == want


def test_texts(spark):
    assert [value(spark, X.bytes_text(F.lit(n))) for n in (0, 1023, 1024, 1536, 1024**2, 3 * 1024**3)] == ["0 B", "1023 B", "1.00 KiB", "1.50 KiB", "1.00 MiB", "3.00 GiB"]
    assert value(spark, X.bytes_readable(F.lit(1610612736))) == "1536.00 MB (1.50 GB)"
    assert [value(spark, X.duration_text(F.lit(s))) for s in (0.0, 59.9, 3661.0, 360000.0, -1.0, math.nan)] == ["00:00:00", "00:00:59", "01:01:01", "100:00:00", "??:??:??", "??:??:??"]
    assert [value(spark, X.clock_secs(F.lit(t))) for t in ("01:02:03.5", "1:2", "a:b:c", "")] == [3723.5, None, None, None]
    assert [value(spark, X.size_reduction(F.lit(a), F.lit(b))) for a, b in ((100, 40), (0, 5), (100, 150))] == [60.0, 0.0, -50.0]
    assert [value(spark, X.audio_kbps(F.lit(c))) for c in (1, 2, 3, 6, 7, 8, 10)] == [64, 128, 144, 256, 336, 384, 480]
    assert value(spark, X.disposition_text({"forced": F.lit(1), "default": F.lit(2), "dub": F.lit(0)})) == "default+forced"
    assert value(spark, X.disposition_text({"dub": F.lit(0)})) == "0"


def test_stream_durations(spark):
    tags = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.lit(None).cast("map<string,string>")
    cases = [("12.5", {}, 12.5), ("", {"DURATION": "00:04:51.530000000"}, 291.53), ("N/A", {"duration": "7"}, 7.0), ("0", {"DURATION": "x", "duration": "0:0:2"}, 2.0), ("", {}, 0.0), ("-3", {}, 0.0), ("00:00:09", {"DURATION": "00:01:00"}, 9.0)]
    assert [value(spark, X.stream_secs(F.lit(d), tags(t))) for d, t, _ in cases] == [pytest.approx(w) for _, _, w in cases]


def test_vocabularies_differ(spark):
    both = lambda p, t, m: (value(spark, X.hdr_from_probe(F.lit(p), F.lit(t), F.lit(m))), value(spark, X.hdr_from_track(F.lit(p), F.lit(t), F.lit(m))))
    assert both("bt2020", "", "") == (True, False) and both("BT.2100", "", "") == (False, True) and both("BT.2020", None, None) == (True, True)
    assert both("", "smpte2084", "") == (True, False) and both("", "SMPTE 2084", "") == (False, True) and both("bt709", "bt709", "bt709") == (False, False)


def test_hdr_matrix(spark):
    side = lambda name, rows: spark.createDataFrame(rows, f"file_id int, {name} boolean")
    e = side("expected_hdr", [(1, True), (2, True), (3, None), (4, False), (5, None), (6, False)])
    a = side("actual_hdr", [(1, True), (2, False), (3, True), (4, None), (5, None)])
    got = {r["file_id"]: (r["is_valid"], r["message"]) for r in hdr.matrix(e, a).collect()}
    assert got == {1: (True, "HDR preserved"), 2: (False, "Expected HDR, found SDR"), 3: (True, "Output is HDR"), 4: (False, "Expected SDR, but could not detect HDR status"), 5: (False, "Could not detect HDR status"), 6: (False, "Expected SDR, but could not detect HDR status")}


def check(spark, expected, actual, streams, **options):
    e = spark.createDataFrame([(1, *expected)], "file_id bigint, width int, height int, duration_secs double, hdr boolean, tracks int")
    a = spark.createDataFrame([(1, *actual)] if actual else [], "file_id bigint, width int, height int, duration_secs double, codec string, bit_depth int, track_depth int, hdr boolean")
    s = spark.createDataFrame([(1, streams)] if streams != [] else [], "file_id bigint, s array<struct<codec string, duration_secs double>>")
    return validation.check(e, a, s, **options).first()


def test_validation_rules(spark):
    good = check(spark, (1920, 800, 100.0, False, 1), (1920, 800, 100.1, "av1", 10, None, False), [("opus", 100.0)])
    assert good["is_valid"] and good["steps"][7]["details"] == "Audio/video sync preserved (drift: 100.0ms)"
    late = check(spark, (1920, 800, 100.0, False, 1), (1920, 800, 100.5, "AV01", 8, 12, True), [("aac", 94.9), ("Opus", 0.0)])
    assert [s["passed"] for s in late["steps"]] == [True, False, True, True, False, False, False, False]
    assert late["steps"][6]["details"] == "Audio stream 0 duration mismatch: got 94.9s, expected 100.0s (diff: 5.1s)"
    far = check(spark, (1920, 1080, 100.0, True, 0), (1920, 800, 101.1, None, None, None, None), [])
    assert [s["details"] for s in far["steps"]][:6] == ["Unknown codec", "10-bit", "Dimension mismatch: got 1920x800, expected 1920x1080", "Duration mismatch: got 101.1s, expected 100.0s (diff: 1.1s)", "Failed to detect HDR status", "No audio tracks"]
    free = check(spark, (None, None, None, None, None), (1, 1, 5.0, "hevc", None, 12, True), None)
    assert [(s["passed"], s["details"]) for s in free["steps"]] == [(False, "Expected AV1, got hevc"), (True, "12-bit"), (True, "No crop validation required"), (True, "Duration validation skipped"), (True, "Output is HDR"), (True, "Failed to get audio info"), (True, "Audio duration validation skipped"), (True, "Sync validation skipped")]
    assert check(spark, (1, 1, 5.0, True, 0), (1, 1, 5.0, "av1", 10, None, None), [], hdr_available=False)["steps"][4]["details"] == "HDR detection not available - validation skipped"
    gone = check(spark, (1, 1, 5.0, True, 0), None, [])
    assert not gone["is_valid"] and [tuple(s) for s in gone["steps"]] == [("Validation", False, "failed to get output video properties")]


def test_descriptions(spark):
    rows = [(1, 0, 0, 0, i, c, "aac", 1.0) for i, c in enumerate([8, 0, 6])] + [(2, 0, 0, 0, 0, 2, "aac", 1.0), (3, 0, 0, 0, 0, 0, "aac", 1.0)]
    df = spark.createDataFrame(rows, "file_id bigint, ord1 int, ord2 int, ord3 int, ord4 int, channels bigint, codec_name string, duration_secs double")
    got = {r["file_id"]: tuple(r)[1:] for r in audio.descriptions(df).collect()}
    assert got[1] == ("2 streams: Stream 0 (8ch), Stream 1 (6ch)", "Stream 0: 8ch [384kbps Opus], Stream 1: 6ch [256kbps Opus]", "Opus (8ch@384k, 6ch@256k)")
    assert got[2] == ("2 channels", "2 channels @ 128kbps Opus", "Opus 2ch @ 128kbps") and got[3] == ("No audio",) * 3


def test_encoder_parameters(spark):
    row = {"ac_bias": "0.05", "variance_boost": True, "boost_strength": 2, "boost_octile": 6, "tune": 0, "film_grain": 8, "film_grain_denoise": False, "crf": 27, "encoder_preset": 6, "denoise_filter": "hqdn3d"}
    df = spark.range(1).withColumns({k: F.lit(v) for k, v in row.items()})
    got = df.select(encoding.encoder_params().alias("p"), encoding.settings_text().alias("s"), encoding.filter_chain(F.lit("crop=1:2:3:4"), F.col("denoise_filter")).alias("f")).first()
    assert got["p"] == "ac-bias=0.05:enable-variance-boost=1:variance-boost-strength=2:variance-octile=6:tune=0:keyint=10s:scd=1:scm=0:film-grain=8:film-grain-denoise=0"
    assert got["s"] == "CRF=27, SVT preset=6, Tune=0, AC bias=0.05, Variance boost=enabled (strength 2, octile 6), Denoise=hqdn3d, Film grain synth=film-grain 8, denoise 0"
    assert got["f"] == "crop=1:2:3:4,hqdn3d" and value(spark, encoding.filter_chain(F.lit(""), F.lit(""))) == ""
    assert [value(spark, encoding.matrix_choice(F.lit(h), F.lit(m))) for h, m in ((True, ""), (True, "x"), (False, "x"))] == ["bt2020nc", "x", "bt709"]


def test_status_and_outcome(spark):
    assert value(spark, results.status(F.lit(True), F.lit(True), F.lit(False))) == "skipped"
    files_ = spark.createDataFrame([(b,) for b in (1, 1, 2, 3, 3, 3)], "batch int")
    done = spark.createDataFrame([(2, 10, 5, 1000, 4000, True, "a.mkv", 1), (3, 10, 5, 0, 1, True, "b.mkv", 2), (3, 10, 20, 0, 1, False, "c.mkv", 3)], "batch int, input_size bigint, output_size bigint, elapsed_ms bigint, video_ms bigint, is_valid boolean, filename string, file_id bigint")
    summed = results.summary(done, files_)
    rows = {r["batch"]: r for r in summed.collect()}
    assert (rows[1]["successful"], rows[1]["avg_speed"], rows[2]["avg_speed"], rows[3]["avg_speed"], rows[3]["failed"]) == (0, 0.0, 4.0, 0.0, 1)
    assert {r["batch"]: r["message"] for r in results.outcome(summed, done).collect()} == {1: "No files were successfully encoded", 2: "Successfully encoded a.mkv", 3: "2 of 3 succeeded"}


def test_listing_a_directory(spark, tmp_path):
    for name in ("b.MKV", "A.mp4", ".hidden.mkv", "_c.ogv", "notes.txt", "none", "mkv"):
        (tmp_path / name).write_bytes(b"x" * 5)
    os.utime(tmp_path / "b.MKV", (1_700_000_000.5, 1_700_000_000.5))
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner.mkv").mkdir()
    (tmp_path / "inner" / "deep.mkv").write_bytes(b"x")
    df = files.list_directory(spark, str(tmp_path))
    got = df.collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["_c.ogv", "A.mp4", "b.MKV"] and got[0]["length"] == 5
    assert df.where("path like '%b.MKV'").select(F.unix_millis("modificationTime")).first()[0] == 1_700_000_000_500
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("path", "string"), ("length", "bigint"), ("modificationTime", "timestamp")]
    with pytest.raises(FileNotFoundError):
        files.list_directory(spark, str(tmp_path / "inner2" if (tmp_path / "inner2").mkdir() else tmp_path / "inner2"))
    (tmp_path / "log").write_bytes(b"frame=1 a\rframe=2 b\nc\r\nd")
    assert [r["line"] for r in files.read_lines(spark, str(tmp_path / "log")).collect()] == ["frame=1 a", "frame=2 b", "c", "d"]


def test_directories_are_listed_by_tasks(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"d{k}").mkdir()
        for i in range(k % 4):
            (tmp_path / f"d{k}" / f"_v{i}.mkv").write_bytes(b"x" * k)
    paths = [str(tmp_path / f"d{k}") for k in range(29)] + [f"file://{tmp_path}/d29"]
    df = files.list_directories(spark, paths, tasks=7)
    assert df.rdd.getNumPartitions() == 7 and sum(r["length"] for r in df.collect()) == sum(k * (k % 4) for k in range(30)) and df.count() == sum(k % 4 for k in range(30))
    assert files.list_directories(spark, paths[:1]).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        files.list_directories(spark, [str(tmp_path / "nowhere")]).collect()
    with pytest.raises(Exception, match="option path or directories"):
        spark.read.format("media_listing").load().collect()


def test_documents_fail_as_a_whole(spark):
    docs = [(1, '{"format": {"duration": "1.5"}, "streams": [{"codec_type": "video", "width": 10, "height": 4}]}'), (2, '{"format": {}, "streams": ['), (3, '{"streams": [{"codec_type": "video", "width": "10"}]}'), (4, "")]
    got = {r["file_id"]: r["failed"] for r in documents.probe_documents(spark.createDataFrame(docs, "file_id int, doc string")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}


def test_names(spark):
    assert [value(spark, listing.output_path(F.lit(p))) for p in ("/a/b.c.mkv", "/a/b", "/a.x/b")] == ["/out/b.c.mkv", "/out/b.mkv", "/out/b.mkv"]


def test_bad_crf_leaves_the_presets_value_if_defaults_are_kept(spark):
    requests = spark.createDataFrame([(1, "Quick", "64", None, None, None), (2, "clean", "20,21,22", 3, None, None), (3, "none", "9", None, None, None)], "request_id int, preset_name string, crf_spec string, encoder_preset int, film_grain int, film_grain_denoise boolean")
    of = lambda keep: {r["request_id"]: (r["crf_sd"], r["crf_hd"], r["crf_uhd"], r["error"]) for r in config.effective(requests, keep).collect()}
    assert of(True)[1] == (32, 35, 36, None) and of(False)[1][3] == "bad_crf_spec"
    assert of(True)[2] == of(False)[2] == (20, 21, 22, None) and of(True)[3][3] == "unknown_preset"


def test_documents_are_read_whole_by_path(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"format": {"duration": "1.5"},\n "streams": [{"codec_type": "video", "width": 1920}]}')
    (tmp_path / "b.json").write_text('{"format": [')
    found = documents.probe_documents(documents.read_documents(spark, str(tmp_path)))
    rows = {os.path.basename(r["file_id"]): (r["failed"], r["d"] and r["d"]["format"] and r["d"]["format"]["duration"]) for r in found.collect()}
    assert rows["a.json"] == (False, "1.5") and rows["b.json"][0]


def test_tables_are_replaced_by_partition(spark, tmp_path):
    steps = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "file_id int, step_no int, details string")
    path = tables.write_table(steps, str(tmp_path), "validation_steps")
    tables.write_table(spark.createDataFrame([(2, 2, "c")], steps.schema), str(tmp_path), "validation_steps")
    assert sorted((r["file_id"], r["step_no"], r["details"]) for r in spark.read.parquet(path).collect()) == [(1, 1, "a"), (2, 2, "c")]
    tables.write_table(steps, str(tmp_path), "batch_summary")
    assert spark.read.parquet(str(tmp_path / "batch_summary")).count() == 2


def test_numbers_go_on_between_ranges(spark):
    rows = spark.range(3000).selectExpr("case when id % 3 < 2 then 'hot' else concat('g', id % 9) end as g", "(id * 7919) % 3000 as x")
    got = numbering.numbered(rows.repartition(5), "g", ["x"]).collect()
    for g in {r["g"] for r in got}:
        mine = sorted((r["x"], r["position"], r["in_group"]) for r in got if r["g"] == g)
        assert [p for _, p, _ in mine] == list(range(1, len(mine) + 1)) and {n for *_, n in mine} == {len(mine)}


def plain_scan(rows):
    """Run numbers and the largest value of the run before each row, job by job."""
    out = {}
    for job in {r[0] for r in rows}:
        run, most = 0, None
        for _, at, start, value in sorted((r for r in rows if r[0] == job), key=lambda r: r[1]):
            if start:
                run, most = run + 1, None
            out[job, at] = (run, most)
            if value is not None:
                most = value if most is None else max(most, value)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_scan_of_runs_goes_on_between_ranges(spark, ranges):
    """One job has nine tenths of the rows; others, and the null job, are small; runs are longer and shorter than ranges."""
    rng = random.Random(ranges)
    rows = [(7 if rng.random() < 0.9 else rng.choice([1, 2, None]), k, rng.random() < (0.001 if k < 2000 else 0.3), rng.choice([None, rng.randrange(100)])) for k in range(4000)]
    df = spark.createDataFrame(rows, "job int, at int, start boolean, value int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = numbering.scan_runs(df, "job", ["at"], F.col("start"), F.col("value"))
        assert got.columns == [*df.columns, "run_no", "before"]
        assert {(r["job"], r["at"]): (r["run_no"], r["before"]) for r in got.collect()} == plain_scan(rows)
        dealt = numbering.in_ranges(df, "job", ["at"])
        largest = max(r["count"] for r in dealt.groupBy("job", numbering.RANGE).count().collect())
        assert largest <= 1.6 * 4000 / ranges
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert numbering.scan_runs(df.limit(0), "job", ["at"], F.col("start")).count() == 0


def test_outputs_of_many_files(spark):
    """Nine tenths of the files share one name, each in a directory of its own."""
    rows = [(k, f"/d{k:03d}/{'same' if k % 10 else f'own{k}'}.mkv", 1) for k in range(400)] + [(1000, "/d0/OWN10.mkv", 1), (1001, "/a/x.txt", 1)]
    got = {r["file_id"]: (r["output_path"], r["rn"], r["blocked_by"]) for r in listing.collisions(spark.createDataFrame(rows, "file_id int, path string, length int")).collect()}
    want = {k: ("/out/same.mkv", i + 1, 1 if i else None) for i, k in enumerate(k for k in range(400) if k % 10)}
    assert got == want


def test_intermediate_tables_have_one_folder_and_go(spark):
    a, b = tables.materialize(spark.range(3), "a"), tables.materialize(spark.range(4), "b")
    top = {f.split("/tables-")[1].split("/")[0] for t in (a, b) for f in t.inputFiles()}
    assert top == {spark.sparkContext.applicationId}
    where = [os.path.dirname(t.inputFiles()[0].removeprefix("file://")) for t in (a, b)]
    tables.release(a)
    assert not os.path.exists(where[0]) and os.path.exists(where[1]) and b.count() == 4


def test_folder_goes_with_the_driver(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
from pyspark.sql import SparkSession
from framelake.sources import tables
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
print(tables.materialize(s.range(3), "a").count())
s.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    for _ in range(50):
        left = [f for f in os.listdir(tmp_path) if f.startswith("tables-")]
        if not left:
            break
        time.sleep(0.2)
    assert out.stdout.split()[-1] == "3" and not left


FACTS = ("m_probe", "m_track", "m_audio", "m_out_audio", "m_crop", "m_output")


def test_bucketed_facts_need_no_shuffle_by_file(spark):
    facts.write_facts({n: relation(spark, SF, n) for n in FACTS}, buckets=4)
    rel = facts.reader(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        read = {
            "encode_plan": catalogue_encode.plans(spark, SF, rel), "validation_steps": validation.steps(catalogue_encode.checked(spark, SF, rel)),
            "validation_wide": validation.wide(catalogue_encode.checked(spark, SF, rel)), "batch_summary": catalogue_encode.summarised(spark, SF, rel=rel), "encode_results": catalogue_encode.encoded(spark, SF, rel=rel),
        }
        for name, df in read.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(file_id" not in plan and "Bucketed: true" in plan, name
            assert plan.count("Exchange") == (2 if name == "batch_summary" else 0), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name, df in read.items():
        assert sorted(map(repr, df.collect())) == sorted(map(repr, registry.queries()[name](spark, SF).select(*df.columns).collect())), name
    facts.write_facts({"m_probe": relation(spark, SF, "m_probe").limit(5)}, buckets=2)
    assert rel("m_probe").count() == 5


def test_sums_of_a_write_equal_the_summary(spark, tmp_path):
    done = catalogue_encode.encoded(spark, SF)
    got = results.write_results(done, str(tmp_path))
    whole = done.withColumn("batch", F.lit(1))
    want = results.summary(whole, whole).first().asDict()
    assert got == {k: want[k] for k in ("successful", "input_bytes", "output_bytes", "elapsed_ms", "video_ms", "passed")} and got["successful"] > 1000
    assert spark.read.parquet(str(tmp_path / "encode_results")).count() == got["successful"]
    assert set(results.write_results(done.limit(0), str(tmp_path), "none").values()) == {0}


def test_rollup_of_null_and_empty_facts(spark):
    kinds = "file_id int, category string, dynamic_range string, preset string, is_valid boolean, input_size bigint, output_size bigint, elapsed_ms bigint, video_ms bigint"
    rows = [(1, "SD", "SDR", "Grain", True, 100, 50, 10, 20), (2, "SD", None, "Grain", False, 0, 0, 0, 0), (3, None, "HDR", "Quick", None, 10, 20, 5, 5)]
    got = {(r["level"], r["category"], r["dynamic_range"], r["preset"]): (r["files"], r["passed"], r["reduction_pct"], r["avg_speed"]) for r in results.rollup(spark.createDataFrame(rows, kinds)).collect()}
    assert got[7, None, None, None] == (3, 1, pytest.approx(100 * 40 / 110), 25 / 15) and got[3, "SD", None, None] == (2, 1, 50.0, 2.0) and got[3, None, None, None] == (1, 0, -100.0, 1.0)
    assert got[0, "SD", None, "Grain"] == (1, 0, 0.0, 0.0) and len(got) == 3 + 3 + 2 + 2 + 3 + 2 + 1
    assert results.rollup(spark.createDataFrame([], kinds)).collect() == []


def test_options_are_one_value(spark):
    plain = options.EncodeOptions().resolved(spark)
    assert (plain["preset"], plain["crf_sd"], plain["crf_hd"], plain["crf_uhd"], plain["encoder_preset"], plain["ac_bias"], plain["crop"], plain["responsive"]) == ("grain", 24, 26, 26, 6, "0.1", True, False)
    o = options.EncodeOptions(crf="20,21,22", encoder_preset=0, film_grain=8, film_grain_denoise=False, responsive=True).having(preset="Quick", crf_hd=63, crop=False)
    got = o.resolved(spark)
    assert {k: got[k] for k in ("preset", "crf_sd", "crf_hd", "crf_uhd", "encoder_preset", "film_grain", "film_grain_denoise", "crop", "responsive")} == {
        "preset": "quick", "crf_sd": 20, "crf_hd": 63, "crf_uhd": 22, "encoder_preset": 0, "film_grain": 8, "film_grain_denoise": False, "crop": False, "responsive": True
    }
    assert options.EncodeOptions(preset="clean", crf="99").resolved(spark)["crf_sd"] == 27  # one that can't be read is ignored
    wrong = {"unknown_preset": {"preset": "it's \\ none"}, "crf_uhd_range": {"crf_uhd": 64}, "crf_sd_range": {"crf_sd": -1}, "encoder_preset_range": {"encoder_preset": 14}, "denoise_without_grain": {"film_grain_denoise": True}}
    for code, given in wrong.items():
        with pytest.raises(options.OptionError) as e:
            options.EncodeOptions(**given).resolved(spark)
        assert e.value.code == code and options.EncodeOptions(**given).frame(spark).count() == 1
    with pytest.raises(dataclasses.FrozenInstanceError):
        o.crf = "1"


def test_options_shape_the_plan(spark):
    tables_ = [relation(spark, SF, n).where("file_id < 400") for n in ("m_probe", "m_track", "m_crop", "m_audio")]
    o = options.EncodeOptions(preset="quick", film_grain=4, crop=False)
    got = encoding.described(*tables_, options=o).collect()
    assert got and all((r["crop_filter"], r["crop_message"], r["crop_disabled"], r["preset_label"]) == ("", "Skipped", True, "Quick") and r["crf"] in (32, 35, 36) and "film-grain=4" in r["svt_params"] for r in got)
    lines = [r["message"] for r in events.plan_lines(encoding.described(*tables_, options=o)).collect()]
    assert lines.count("Crop detection: disabled") == len(got) == lines.count("Profile: Quick")


def test_files_of_one_request_stay_spread(spark, monkeypatch):
    files_ = spark.range(500).selectExpr("id as file_id", "if(id % 10 = 0, cast(id as int), 3) as request_id")
    requests = spark.createDataFrame([(i, "clean" if i % 2 else "ultra", None, None, None, None) for i in range(0, 500)], "request_id int, preset_name string, crf_spec string, encoder_preset int, film_grain int, film_grain_denoise boolean")
    tuning = spark.createDataFrame([], "request_id int, variance_boost boolean, boost_strength int, boost_octile int, denoise_filter string")
    found = sorted(map(tuple, encoding.file_settings(files_, requests, tuning).collect()))
    assert len(found) == 450
    monkeypatch.setattr(encoding, "BROADCAST_REQUESTS", 10)
    assert sorted(map(tuple, encoding.file_settings(files_, requests, tuning).collect())) == found


DEALT_QUERIES = ["crop_detection", "crop_sample_mode", "crop_decision", "audio_streams", "crop_candidates", "crop_top10", "audio_channels", "audio_description", "encode_tasks"]


@pytest.mark.parametrize("name", DEALT_QUERIES)
def test_parts_grow_in_number_not_in_size(spark, monkeypatch, name):
    """The largest table is dealt by its key before anything sorts or counts it, to parts of so many rows."""
    want = sorted(map(repr, registry.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(tables, "PART_ROWS", 500)
    df = registry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert dealt and {int(n) for n in dealt} == {-(-rows // 500)}
    assert sorted(map(repr, df.collect())) == want


def test_crops_of_four_numbers_only(spark):
    crops = ["10:20:0:4", "010:20:0:4", "10:20:0", "10:20:0:4:1", "x:1:2", "10:20:-1:4", "10:20:0:4\n", "99999999999:20:0:4", "4294967296:20:0:4"]
    got = [tuple(r)[1:] for r in crop._with_numbers(spark.createDataFrame([(c,) for c in crops], "crop string")).select("crop", "w", "h", "x", "y").collect()]
    none = (None,) * 4
    assert got == [(10, 20, 0, 4), (10, 20, 0, 4), none, none, none, none, none, none, (None, 20, 0, 4)]


def test_tasks_read_plans_and_streams_once(spark):
    plans = spark.createDataFrame([(1,), (2,)], "file_id int")
    streams = spark.createDataFrame([(1, 1, 128, "0"), (1, 0, 64, "default"), (3, 0, 64, "0")], "file_id int, audio_index int, bitrate_kbps bigint, disposition string")
    df = encoding.tasks(plans, streams)
    want = [(1, 0, "video", None, None, None, ""), (1, 1, "audio", 0, 64, "default", ""), (1, 2, "audio", 1, 128, "0", ""), (1, 3, "mux", None, None, None, "0,1,2"), (2, 0, "video", None, None, None, ""), (2, 1, "mux", None, None, None, "0")]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[:2]) == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_wide_events_are_the_packed_ones_laid_out(spark):
    rows = spark.createDataFrame([(7, 100, 10, 4, 60.0), (8, 101, None, 5, None)], "file_id int, ts_epoch bigint, input_size bigint, output_size bigint, reduction_pct double")
    wide, packed = events.result_events(rows, wide=True), events.flat(events.result_events(rows))
    assert wide.dtypes == packed.dtypes and sorted(map(repr, wide.collect())) == sorted(map(repr, packed.collect()))
    assert "variant" not in wide._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_is_decoded_once_also_where_rejects_are_filtered(spark):
    docs = spark.createDataFrame([(1, '{"streams":'), (2, '{"format":{"duration":"1d"},"streams":[]}'), (3, '{"streams":[]}'), (4, '{"streams":[{"codec_type":"video","width":2,"height":2}]}')], "file_id bigint, doc string")
    df = probe.rejects(documents.probe_documents(docs))
    assert {r["file_id"]: r["error_reason"] for r in df.collect()} == {1: "unreadable document", 2: "unreadable duration", 3: "no video stream"}
    assert optimized(df).count("from_json(") == 1


def test_steps_are_made_once_also_where_failures_are_filtered(spark):
    assert optimized(validation.failures(catalogue_encode.checked(spark, SF))).count("AV1 (") == 1


def test_requests_are_checked_once_and_by_several_tasks(spark):
    rows = [(1, None, "27", None, None, None), (2, "none", None, None, None, None), (3, None, "64", None, None, None), (4, "quick", None, 14, None, None)]
    asked = spark.createDataFrame(rows, "request_id bigint, preset_name string, crf_spec string, encoder_preset int, film_grain int, film_grain_denoise boolean")
    df = config.resolved(asked)
    assert [(r["request_id"], r["crf_uhd"]) for r in df.collect()] == [(1, 27)]
    assert "Filter isnull(error#" in optimized(df)


def test_texts_of_a_progress_line_are_matched_once(spark):
    lines = spark.createDataFrame([(1, "frame= 7 fps= 2.5 q=1 time=00:01:02.5 bitrate=9k speed=1.5x", 125.0), (2, "frame=x fps=N/A time=N/A ", 125.0)], "event_id bigint, line string, duration_secs double")
    df = progress.parse_lines(lines)
    assert [tuple(r) for r in df.select("frame", "fps", "bitrate", "speed", "elapsed", "percent", "eta").orderBy("event_id").collect()] == [(7, 2.5, "9k", 1.5, 62.5, 50.0, 41), (0, 0.0, "", 0.0, 0.0, 0.0, 0)]
    assert optimized(df).count("regexp_extract(") == 5


def test_a_log_file_needs_no_lines_for_debugging_and_formats_a_time_once(spark):
    plan = optimized(catalogue_events.log_written(spark, SF))
    assert "Crop candidates" not in plan and "make_dt_interval" not in plan and "frame= *" not in plan
    lines = spark.createDataFrame([("INFO", "a", "2024-05-06 07:08:09")], "level string, message string, ts string")
    df = events.written(lines, F.col("ts").cast("timestamp_ntz"))
    assert optimized(df).count("date_format(") == 1 and tuple(df.first()) == ("2024-05-06", "2024-05-06 07:08:09 [INFO] a")


def test_only_what_is_said_of_streams_is_collected(spark):
    assert optimized(catalogue_encode.checked(spark, SF)).count("collect_list(") == 1
    for df in (catalogue_encode.plans(spark, SF), catalogue_encode.requested_plans(spark, SF)):
        assert "l_tax" not in df._jdf.queryExecution().executedPlan().toString()
    rows = [(1, 2, 1, 1, 1, 6, "AAC", 1.0), (1, 1, None, 1, 1, 2, "opus", None), (1, 1, 3, 1, 1, 0, "x", 1.0), (1, None, 9, 1, 1, 8, None, 2.0), (2, 1, 1, 1, 1, 0, "x", 1.0)]
    sounds = spark.createDataFrame(rows, "file_id bigint, ord1 int, ord2 int, ord3 int, ord4 int, channels bigint, codec_name string, duration_secs double")
    assert [tuple(r) for r in audio.ordered_channels(sounds).collect()] == [(1, [8, 2, 6])]
    assert [[x["codec"] for x in r["s"]] for r in audio.ordered(sounds).collect()] == [[None, "opus", "aac"]]
