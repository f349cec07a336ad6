"""Golden facts of the operators, and properties against plain Python."""

import hashlib
import io
import json
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird import schemas as schemas_
from lyrebird.functions import arrays, frames, maths, splits, text
from lyrebird.functions.tokenizers import ByteTrie, build
from lyrebird import schemas as schemas_
from lyrebird.operators import batching, decode, index, metrics, runs, sinks, stats
from lyrebird.sources import manifests


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_split_matches_sha1(spark):
    rule = splits.HashSplit(0.1, 7)
    rows = spark.range(500).select(
        "id", rule.side(F.col("id")).alias("s"), rule.on("eval", shard=F.col("id")).alias("e"),
        rule.on("all").alias("w"),
    ).collect()
    for r in rows:
        x = int.from_bytes(hashlib.sha1(f"7:{r.id}".encode()).digest()[:8], "big") / float(1 << 64)
        assert r.s == ("eval" if x < 0.1 else "train") and r.e == (r.s == "eval") and r.w
    assert one(spark, splits.HashSplit(0.0).side(F.lit("a")).alias("s")).s == "train"
    for wrong in ({"share": 1.0}, {"sides": ("a", "a")}, {"by": "x"}, {"id_field": ""}):
        with pytest.raises(ValueError):
            splits.HashSplit(**wrong)
    with pytest.raises(ValueError, match="no split"):
        rule.on("dev", shard=F.lit("a"))
    with pytest.raises(ValueError, match="shard_name"):
        rule.on("eval", sample=F.lit("a"))


def test_frames(spark):
    none = F.lit(None).cast("double")
    f = frames.infer_frames
    r = one(
        spark,
        f(none, F.lit(0.25), F.lit(1.70), none, none, none).alias("a"),
        f(none, F.lit(0.0), F.lit(2.34), none, none, none).alias("b"),
        f(none, none, none, F.lit(1.25), none, none).alias("c"),
        f(F.lit(0), none, none, none, F.lit(16000), F.lit(16000)).alias("d"),
        f(none, none, none, F.lit(0.001), none, none).alias("e"),
        f(none, none, none, F.lit(0.025), none, none).alias("g"),
    )
    assert tuple(r) == (145, 234, 125, 100, 1, 2)
    with pytest.raises(Exception, match="no length"):
        one(spark, f(none, F.lit(2.0), F.lit(1.0), F.lit(5.0), none, none))
    assert one(spark, frames.subsampled_length(F.lit(0)).alias("x")).x == 0
    assert one(spark, frames.memory_token_budget(F.lit(3000), F.lit(6 * 1024**3), 22.0).alias("x")).x == 11000


def test_greedy_batches_fact(spark):
    rows = spark.createDataFrame(
        [(0, i, n) for i, n in enumerate([100, 110, 120, 130, 500, 520, 540, 560])], "g int, i int, n long",
    )
    got = batching.greedy_batches(rows, ["g"], "n", ["i"], 4, 500).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [3, 1, 1, 1, 1, 1]


def test_greedy_batches_against_a_loop(spark):
    rng = random.Random(3)
    for world, most, budget in ((1, 5, 300), (1, 3, None), (3, 4, 200)):
        lengths = sorted(rng.choice([10, 20, 20, 50, 90, 400]) for _ in range(200))
        rows = spark.createDataFrame([("x", i, n) for i, n in enumerate(lengths)], "g string, i int, n long")
        want, at, batch = {}, 0, 0
        while len(lengths) - at >= world:
            size = world
            while at + size + world <= len(lengths) and (size + world) // world <= most and (
                not budget or (size + world) // world * lengths[at + size + world - 1] <= budget
            ):
                size += world
            want |= {i: batch for i in range(at, at + size)}
            at, batch = at + size, batch + 1
        got = {r.i: r.batch for r in batching.greedy_batches(rows, ["g"], "n", ["i"], most, budget, world).collect()}
        assert got == want


def test_token_budgets(spark):
    rows = spark.createDataFrame(
        [(0, i, f, t) for i, (f, t) in enumerate([(8, 3), (5, 2), (3, 1)])], "g int, i int, f long, t long",
    )
    s = batching.batch_stats(rows, ["g"], "f", "t", 4).first()
    assert (
        s.padded_frames, s.text_tokens, s.padded_text, s.budget_tokens, s.total_tokens, s.effective_budget,
        s.effective_padded_text,
    ) == (24, 6, 9, 33, 30, 45, 21)
    split = batching.token_split(rows, ["g"], ["i"], "f", "t", 18).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in split] == [1, 2]
    assert batching.token_split(rows, ["g"], ["i"], "f", "t", 6).count() == 1
    prefix = lambda **k: tuple(batching.budget_prefix(rows, ["g"], ["i"], "f", "t", **k).first())[1:]
    assert prefix(budget=18) == (1, 0, 2)
    assert prefix(budget=40, extra=4, padded_text=True) == (2, 0, 1)
    assert prefix(budget=None, text_budget=4) == (1, 0, 2)


def test_pairing_in_order(spark):
    rng = random.Random(5)
    members, want = [], set()
    for s in range(30):
        waiting: dict[str, tuple[str, int]] = {}
        for at in range(25):
            key, kind = rng.choice("ab"), rng.choice(["audio", "json"])
            members.append((s, key, kind, at))
            if key in waiting and waiting[key][0] != kind:
                other = waiting.pop(key)[1]
                want.add((s, key, at, other) if kind == "audio" else (s, key, other, at))
            else:
                waiting[key] = (kind, at)
    df = spark.createDataFrame(members, "s int, key string, kind string, at int")
    got = {(r.s, r.key, r.audio_at, r.json_at) for r in index.pair_in_order(df, "s", "key", "kind", "at").collect()}
    assert got == want


def test_quantiles_nearest_rank(spark):
    rng = np.random.default_rng(1)
    values = {
        "a": rng.normal(size=2001), "b": np.repeat([1.0, 2.0], 500), "c": np.array([7.0]),
        "d": np.append(rng.normal(size=400), 1e12),
    }
    rows = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    for accuracy in (20, 10_000):
        got = {
            r.g: r for r in stats.quantiles(rows, ["g"], "v", {"p50": 0.5, "p99": 0.99}, accuracy=accuracy).collect()
        }
        for g, vs in values.items():
            s = np.sort(vs)
            assert got[g].p50 == s[round((len(s) - 1) * 0.5)] and got[g].p99 == s[round((len(s) - 1) * 0.99)]
    whole = stats.quantiles(rows, [], "v", {"p50": 0.5}).first()
    every = np.sort(np.concatenate(list(values.values())))
    assert whole.n == len(every) and whole.p50 == every[round((len(every) - 1) * 0.5)]
    assert tuple(stats.quantiles(rows.limit(0), [], "v", {"p50": 0.5, "max": 1.0}).first()) == (0, 0.0, 0.0, 0.0)


def test_edit_distance(spark):
    def dp(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    pairs = [
        (
            [rng.choice("abcd") for _ in range(rng.randint(0, 9))],
            [rng.choice("abcd") for _ in range(rng.randint(0, 9))],
        ) for _ in range(100)
    ]
    rows = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>",
    )
    for r in rows.select("a", "b", maths.edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == dp(r.a, r.b)
    assert one(spark, maths.rate(F.lit(1), F.lit(0)).alias("x")).x == 0


def test_beam_search_facts():
    log = lambda m: np.log(np.array(m))
    p = log([[0.6, 0.4], [0.6, 0.4]])
    assert decode.prefix_beam(p, 0, 1)[0][0] == ()
    assert decode.prefix_beam(p, 0, 2)[0][0] == (1,)
    assert decode.prefix_beam(log([[0.9, 0.1]] * 2), 0, 4, bonus=decode.Bonus(5.0))[0][0] != ()
    words = decode.Bonus(hotwords=[((2,), 3.0)])
    q = log([[0.01, 0.51, 0.48]])
    assert decode.prefix_beam(q, 0, 4)[0][0] == (1,) and decode.prefix_beam(q, 0, 4, bonus=words)[0][0] == (2,)


def test_alignment_facts(spark):
    m = np.full((5, 3), np.log(0.05))
    for t, k in enumerate([0, 1, 1, 0, 2]):
        m[t, k] = np.log(0.9)
    assert decode.align(m, [1, 2], 0) == [(1, 2), (4, 4)]
    spans = F.array(
        F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")),
        F.struct(F.lit(4).alias("start"), F.lit(4).alias("end")),
    )
    a = one(spark, decode.token_alignments(spans, F.array(F.lit(1), F.lit(2)), "linear").alias("a")).a
    assert [(x.start_ms, x.end_ms) for x in a] == [(10.0, 30.0), (40.0, 50.0)]
    with pytest.raises(ValueError):
        decode.align(m[:1], [1, 2], 0)


def test_greedy(spark):
    scores = F.lit([[9.0, 1, 1], [1, 9.0, 1], [1, 9.0, 1], [9.0, 1, 1], [1, 1, 9.0]])
    assert one(spark, decode.greedy(scores, 0).alias("x")).x == [1, 2]


def test_text(spark):
    r = one(
        spark, text.hotword(F.lit("搜狐体育\t6.5"), 3.0).alias("a"), text.hotword(F.lit("wizard"), 3.0).alias("b"), text.hotword(F.lit(" # no"), 3.0).alias("c"), text.hotword(F.lit("x\ty"), 3.0).alias("d"),
        text.key_values(F.lit("a=1 b=-2.5 a=3")).alias("e"), text.short_text(F.lit("ab  cd ef"), 6).alias("f"), text.step_number(F.lit("/x/step-12.pt")).alias("g"), text.step_number(F.lit("best.pt")).alias("h"),
        arrays.append_eos(
            arrays.append_eos(F.array(F.lit(1)), 0), 0,
        ).alias("i"), arrays.label_mask(F.lit([7, 8, 13, 0]), 2, F.lit(7) + 1).alias("j"),
    )
    assert tuple(r.a) == ("搜狐体育", 6.5) and tuple(r.b) == ("wizard", 3.0) and r.c is None and tuple(r.d) == ("x\ty", 3.0)
    assert r.e == {"a": 3.0, "b": -2.5} and (r.g, r.h) == (12, -1) and r.i == [1, 0] and r.j == [-100] * 10 + [7, 8, 13, 0]
    df = spark.createDataFrame([("Ｈello, Straße!",)], "t string").select(
        text.normalize_english()("t").alias("e"), text.normalize_chinese()("t").alias("c"),
    ).first()
    assert df.e == "hello strasse" and df.c == "HelloStraße"


def test_byte_trie():
    t = ByteTrie(
        [f"{i + 1} {bytes([i])!r} 1" for i in range(128)] + ["200 'th' 2", "201 'the' 3", "202 b'\\xe4\\xbd' 2"]
    )
    assert t.encode("then") == [201, ord("n") + 1] and t.decode(t.encode("the tha")) == "the tha"
    # The end mark and unknown ids decode to nothing, and the vocabulary keeps its published size.
    assert t.eos == 0 and t.vocab_size == 65_536 and t.decode(
        [0, *t.encode("the"), 65_535]
    ) == "the" and t.decode([202]) == ""
    with pytest.raises(KeyError):
        t.encode("é")
    with pytest.raises(ValueError):
        build("sentencepiece", None)


def test_status_rules(spark):
    n = F.lit(None).cast("double")
    r = one(
        spark, runs.eval_class(F.lit(1.0), F.lit(1.2), F.lit(0.5)), runs.overall_class(
            F.lit(1.0), F.lit(0.8), F.lit(0.5), n,
        ), runs.ctc_preview_class(F.lit(0.9), F.lit(1.0), n), runs.ar_preview_class(F.lit(1.0), n, F.lit(0.2)),
    )
    assert tuple(r) == ("improved", "needs-attention", "transitioning", "no EOS")


def test_union_of_roots_checks_names(spark):
    a, b = spark.createDataFrame([("s1",)], "shard_name string"), spark.createDataFrame([("s2",)], "shard_name string")
    assert index.union_roots(a, b).count() == 2
    with pytest.raises(Exception, match="two roots"):
        index.union_roots(a, a).collect()


def test_compare(spark):
    a, b = spark.createDataFrame([("x", 5, 10), ("y", 1, 0)], "u string, e int, t int"), spark.createDataFrame(
        [("x", 1, 10), ("y", 1, 1), ("z", 0, 4)], "u string, e int, t int",
    )
    r = metrics.compare(a, b, "u", "e", "t").first()
    assert (
        r.shared, r.improved, r.worsened, r.unchanged,
    ) == (2, 1, 0, 1) and r.rate_a == 6 / 11 and r.verdict.startswith("b improved")


def _shard(path, samples):
    with tarfile.open(path, "w") as t:
        for key, meta, audio in samples:
            for name, raw in ((f"{key}.wav", audio), (f"{key}.json", json.dumps(meta).encode())):
                info = tarfile.TarInfo(name)
                info.size = len(raw)
                t.addfile(info, io.BytesIO(raw))


def test_tar_source(spark, tmp_path):
    from lyrebird.sources import tars

    _shard(
        tmp_path / "a.tar",
        [("abc", {"sid": "u1", "begin_time": 0.0, "end_time": 2.34}, b"1234"), ("def", {"duration": 1.25}, b"56")],
    )
    _shard(tmp_path / "b.tar", [("ghi", {"sid": "", "duration": 1.0}, b"789")])
    spark.dataSource.register(tars.TarShards)
    for members in (
        spark.read.format("tarshard").option("payload", "true").load(str(tmp_path)),
        tars.members_of(spark, str(tmp_path), payload=True),
    ):
        entries = tars.length_entries(members, splits.HashSplit(0.0))
        got = {(r.shard_name, r.utt_id, r.num_frames, r.split) for r in entries.collect()}
        assert got == {("a.tar", "u1", 234, "train"), ("a.tar", "def", 125, "train"), ("b.tar", "ghi", 100, "train")}
    read = tars.read_members(entries, str(tmp_path)).collect()
    assert {bytes(r.payload) for r in read} == {b"1234", b"56", b"789"}


def test_manifest(spark, tmp_path):
    from lyrebird.sources import manifests

    p = tmp_path / "m.jsonl"
    p.write_text('{"utt_id": "", "id": "u0", "token_ids": [1], "feature_path": "f.pt"}\n')
    r = manifests.manifest(spark, str(p)).first()
    assert r.utt_id == "u0" and r.feature_path == f"{tmp_path}/f.pt"
    p.write_text('{"token_ids": [1]}\n')
    with pytest.raises(Exception, match="no id"):
        manifests.manifest(spark, str(p)).collect()
    assert manifests.predictions(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_batcher_carries_over(spark, tmp_path):
    from lyrebird.operators.batching import Batcher

    b, state, out = Batcher(18, 10), (0, 0, 0, 0), []
    for f, t in ((8, 3), (5, 2), (3, 1)):
        state, n = b.step(state, f, t)
        out.append(n)
    assert out == [0, 1, 1]


def test_archives_and_audio(spark, tmp_path):
    import gzip
    import wave

    from lyrebird.sources import archives

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, text_ in (
            ("f/dev/eng.dev", "one \n\n two"), ("f/devtest/fra.devtest", "trois"), ("f/README", "no"),
            ("dev/x.dev", "no"),
        ):
            info = tarfile.TarInfo(name)
            info.size = len(text_.encode())
            t.addfile(info, io.BytesIO(text_.encode()))
    (tmp_path / "c.tar.gz").write_bytes(gzip.compress(raw.getvalue()))
    lines = archives.corpus_lines(spark, str(tmp_path / "c.tar.gz"))
    assert sorted((r.lang, r.line) for r in lines.collect()) == [("eng", "one"), ("eng", "two"), ("fra", "trois")]
    assert tuple(archives.corpus_counts(lines).first()) == (3, 2, 2)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(16_000)
        tone = (np.sin(np.arange(16_000) * 2 * np.pi * 1000 / 16_000) * 8000).astype("<i2")
        w.writeframes(np.stack([tone, tone], 1).tobytes())
    frames_ = archives.fbank(archives.samples(out.getvalue()))
    assert frames_.shape == (98, 80) and (frames_.argmax(1) == frames_[0].argmax()).all()


def test_config(tmp_path):
    from lyrebird.functions import config

    rule = splits.HashSplit(0.1, 7)
    config.check_index({"split": {"split_by": "shard_name", "eval_ratio": 0.1, "hash_seed": 7}}, rule)
    with pytest.raises(ValueError, match="split_by"):
        config.check_index({"split": {"eval_ratio": 0.1, "hash_seed": 7}}, rule)
    assert config.artefact_path("index", str(tmp_path)).endswith("/webdataset_index.json") and config.artefact_path("lengths", "/a/b.tar") == "/a/b.lengths.jsonl"
    trie = ByteTrie([f"{i} {bytes([i])!r} 1" for i in range(128)], eos=None, least=0)
    assert config.vocab_size(trie) == 128 and config.text_extra(*config.prompt_ids(trie, "ab", "", "c")) == 4
    with pytest.raises(ValueError):
        config.vocab_size(trie, append_eos=True)


def test_examples(spark):
    from lyrebird.operators import reports

    kind = "utt_id string, pred_token_ids array<int>, ref_token_ids array<int>, ref_text string, pred_text string, debug struct<eos_emitted: boolean>"
    a = spark.createDataFrame([("u", [1, 2], [1, 2, 3, 4], "r", "x", None), ("v", [1], [1], "s", "y", None)], kind)
    b = spark.createDataFrame([("u", [1, 2, 3, 4], [1, 2, 3, 4], "r", "z", (False,))], kind)
    r = reports.examples(a, b, "utt_id", 5).collect()
    assert len(r) == 1 and (r[0].ctc_error, r[0].ar_error) == (0.5, 0.0)
    assert r[0].comment == "AR closer on token edit distance; CTC is short; AR did not emit EOS."


def test_token_split_against_a_loop(spark):
    rng = random.Random(11)
    rows = [(rng.choice("abc"), i, rng.randint(1, 60), rng.randint(0, 9)) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, i int, f int, t int")
    for budget, most, skip, padded, extra in (
        (90, None, True, False, 0), (90, 3, False, False, 0), (120, 4, False, True, 2), (0, 5, True, False, 0),
    ):
        want = {}
        for g in "abc":
            held, batch = [], 0
            for _, i, f, t in (r for r in rows if r[0] == g):
                cost = lambda x: len(x) * max(a for a, _ in x) + (
                    len(x) * (max(b for _, b in x) + extra) if padded else sum(b for _, b in x)
                )  # noqa: E731, B023
                over = budget > 0 and cost([(f, t)]) > budget
                if over and skip:
                    continue
                if held and (most and len(held) >= most or budget > 0 and cost([*held, (f, t)]) > budget):
                    held, batch = [], batch + 1
                want[i] = batch
                held, batch = ([], batch + 1) if over else ([*held, (f, t)], batch)
        got = {
            r.i: r.batch for r in batching.token_split(
                frame, ["g"], ["i"], "f", "t", budget, most, skip, padded, extra,
            ).collect()
        }
        assert got == want


def test_preview_and_parts(spark, tmp_path):
    from lyrebird import schemas

    prediction = spark.createDataFrame(
        [
            (
                "u1", [1], [1, 2], None, "ref", 0.123456, "ctc", None, None, None, "bi", None,
                {
                    "feature_length": 9, "logit_length": 3, "pred_token_count": 1, "ref_token_count": 2,
                    "blank_top1_ratio": 0.5, "avg_blank_prob": 0.25,
                },
            ),
            ("u2", [1], [1], "hyp", None, -1.0, "rescore", 0.5, None, -0.25, "bi", None, None),
            ("u3", None, None, None, None, 0.0, "ctc", None, None, None, "bi", None, None),
        ],
        schemas.PREDICTION,
    )
    got = [r.value for r in sinks.preview(prediction, "utt_id", 2).orderBy("place").collect()]
    assert got == [
        "[1] utt_id=u1\n  REF : ref\n  PRED: \n  SCORE: 0.1235\n  DEBUG: feat=9 logit=3 pred_tok=1 ref_tok=2 blank_top1=0.500 avg_blank=0.250",
        "[2] utt_id=u2\n  REF : \n  PRED: hyp\n  SCORE: -1.0000\n  STRATEGY: rescore\n  RESCORE: ctc=0.5 decoder=n/a combined=-0.25",
    ]
    sinks.write_preview(prediction, str(tmp_path / "p"), "utt_id", 2)
    text_ = "".join(p.read_text() for p in (tmp_path / "p").glob("part-*"))
    assert text_ == "\n".join(got) + "\n"
    values = manifests.preview_lines(spark, str(tmp_path / "p")).collect()
    assert [r["values"] for r in values] == [
        {"feat": 9.0, "logit": 3.0, "pred_tok": 1.0, "ref_tok": 2.0, "blank_top1": 0.5, "avg_blank": 0.25}
    ]
    sinks.write_predictions(prediction, str(tmp_path / "j"))
    assert sorted(
        map(str, manifests.predictions(spark, str(tmp_path / "j")).collect())
    ) == sorted(map(str, prediction.collect()))
    ids = [f"k{i * 7 % 1000:04}" for i in range(1000)]
    for order in ("name", "number"):
        rows = spark.createDataFrame(
            [(x, int(x[1:]), [[0.0, 1.0]] * 2) for x in ids], "name string, number int, scores array<array<double>>",
        )
        parts, listed = sinks.export_parts(rows, order, 64, "scores")
        assert {r.name: r.part_index for r in parts.collect()} == {x: i // 64 for i, x in enumerate(sorted(ids))}
        assert sorted(tuple(r) for r in listed.collect()) == [(i, min(64, 1000 - 64 * i), 2, 2) for i in range(16)]


def test_bucket_manifest_round_trip(spark, tmp_path):
    entries = spark.createDataFrame(
        [
            (
                f"s{i % 3}.tar", f"k{i}", f"u{i}", "train" if i % 4 else "eval", 40 + 30 * (i % 5), f"k{i}.wav", "wav",
                f"k{i}.json", 512 * i, 100, 0, 1, None,
            ) for i in range(40)
        ],
        schemas_.LENGTH_ENTRY,
    )
    sinks.write_buckets(entries, str(tmp_path), "/shards", "lengths.jsonl", entries_per_part=3)
    listed = manifests.bucket_manifest(spark, str(tmp_path / "manifest.json")).collect()
    assert sum(r.num_samples for r in listed) == 40 and {r.bucket_id for r in listed} == {0, 1, 2}
    assert [(r.split, r.bucket_id) for r in listed] == sorted((r.split, r.bucket_id) for r in listed)
    for r in listed:
        assert sum(p.num_samples for p in r.parts) == r.num_samples and all(p.num_samples <= 3 for p in r.parts)
        taken = []
        for p in r.parts:
            rows = [json.loads(line) for f in (tmp_path / p.path).glob("part-*") for line in f.read_text().splitlines()]
            assert len(rows) == p.num_samples and (
                rows[0]["shard_name"], rows[-1]["shard_name"],
            ) == (p.first_shard, p.last_shard)
            taken += rows
        want = sorted(
            (
                e for e in entries.collect() if e.split == r.split and e.num_frames // 80 == r.bucket_id
            ), key=lambda e: (e.shard_name, e.audio_offset)
        )
        assert [x["utt_id"] for x in taken] == [e.utt_id for e in want]


def test_edit_distance_guard(spark, monkeypatch):
    monkeypatch.setattr(maths, "MOST_ITEMS", 3)
    with pytest.raises(Exception, match="too many"):
        one(spark, maths.edit_distance(F.array(*map(F.lit, "abcd")), F.array(F.lit("a"))))


def test_floored_rate_without_rows(spark):
    assert metrics.floored_rate(spark.createDataFrame([], "e int, t int"), "e", "t").first().rate == 0


def test_tensor_files(spark, tmp_path):
    from lyrebird.sources import tensors

    x = np.arange(24, dtype=np.float32).reshape(2, 4, 3)
    (tmp_path / "a.safetensors").write_bytes(tensors.to_bytes({"logits": x, "lengths": np.array([4, 2])}))
    rows = tensors.scores(spark, str(tmp_path / "a.safetensors")).orderBy("place").collect()
    assert [(r.place, r.length) for r in rows] == [(0, 4), (1, 2)] and rows[1].scores == x[1, :2].tolist()
    header = b'{"x": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}}'
    assert tensors.tensors(
        len(header).to_bytes(8, "little") + header + b"\xc0\x3f\x00\xc0"
    )["x"].tolist() == [1.5, -2.0]
    for lengths, message in ((np.array([1]), "lengths"), (np.array([5, 1]), "beyond")):
        (tmp_path / "b.safetensors").write_bytes(tensors.to_bytes({"logits": x, "lengths": lengths}))
        with pytest.raises(Exception, match=message):
            tensors.scores(spark, str(tmp_path / "b.safetensors")).collect()
    (tmp_path / "b.safetensors").write_bytes(tensors.to_bytes({"logits": x}))
    with pytest.raises(Exception, match="no tensor"):
        tensors.scores(spark, str(tmp_path / "b.safetensors")).collect()


def test_throughput_and_budgets(spark):
    r = one(
        spark, frames.throughput(F.lit(30), F.lit(10.0), 10).alias("a"),
        frames.throughput(F.lit(0), F.lit(0.0)).alias("b"),
    )
    assert tuple(r) == (2.0, 1e6)
    ranks = spark.createDataFrame([(1, 100, 1000), (1, 100, 4000), (2, 0, 50)], "step int, tokens long, peak long")
    got = {
        r.step: (r.peak, r.budget) for r in batching.global_token_budget(
            ranks, "step", "tokens", "peak", 1 / 1024,
        ).collect()
    }
    assert got == {1: (4000, 26214), 2: (50, 20971)}


def test_loader_and_steps(spark, tmp_path):
    from lyrebird.functions import config

    assert config.loader(str(tmp_path)) == ("shards", None)
    (tmp_path / "webdataset_lengths.jsonl").write_text("{}\n")
    assert config.loader(str(tmp_path))[0] == "lengths" and config.loader(str(tmp_path), limit=1) == ("shards", None)
    (tmp_path / "webdataset_buckets").mkdir()
    (tmp_path / "webdataset_buckets" / "manifest.json").write_text("{}")
    assert config.loader(str(tmp_path))[0] == "buckets"
    with pytest.raises(FileNotFoundError):
        config.loader(str(tmp_path), lengths=str(tmp_path / "none"), buckets=str(tmp_path / "none"))
    buckets = spark.createDataFrame([(0, 10), (1, 7)], "bucket_id int, num_samples long")
    lengths = spark.createDataFrame([(n,) for n in (100, 110, 120, 130, 500, 520, 540, 560)], "num_frames int")
    assert batching.epoch_steps("buckets", 4, buckets=buckets, budget=320) == 10 // 4 + 7 // 2
    assert batching.epoch_steps(
        "lengths", 4, lengths=lengths, budget=500,
    ) == 6 and batching.epoch_steps("lengths", 4, lengths=lengths.limit(0)) == 1
    assert batching.epoch_steps("shards", 4, samples=9) == 3
    with pytest.raises(ValueError):
        batching.epoch_steps("shards", 4)
    rule = splits.HashSplit(0.1, 7)
    document = {
        "split": {"split_by": "shard_name", "eval_ratio": 0.1, "hash_seed": 7}, "num_samples": 9,
        "splits": {"eval": {"num_samples": 2}},
    }
    assert config.progress_total(document, rule, "all") == 9 and config.progress_total(document, rule, "eval") == 2
    assert config.progress_total(document, rule, "dev") is None and config.progress_total(None, rule, "all") is None and config.progress_total(document, splits.HashSplit(0.2), "all") is None


def test_prediction_jobs(spark):
    scores = [[9.0 if t == k else 1.0 for t in range(3)] for k in (0, 1, 1, 0, 2)]
    rows = spark.createDataFrame(
        [("b", scores, [1, 2, 0]), ("a", scores[:1], None), ("c", scores, [1])],
        "utt_id string, scores array<array<double>>, ref array<int>",
    )
    got = {r.utt_id: r for r in decode.predictions(rows, "scores", reference="ref", eos=0, limit=2).collect()}
    assert set(got) == {"a", "b"} and got["b"].pred_token_ids == got["b"].ref_token_ids == [1, 2] and got["a"].ref_token_ids is None
    assert got["b"].debug.logit_length == 5 and got["b"].debug.ref_token_count == 2 and got["b"].debug.blank_top1_ratio == 0.4 and got["a"].pred_token_ids == []
    with pytest.raises(ValueError):
        decode.predictions(rows, "scores", limit=0)
    report = {
        r["mode"]: tuple(r)[1:] for r in metrics.mode_report(
            spark.createDataFrame([("bi", 0, 4), ("bi", 2, 4), ("uni", 3, 0)], "mode string, e int, t int"), "mode",
            "e", "t",
        ).collect()
    }
    assert report == {"bi": (0.25, 0.5, 2.0), "uni": (0.0, 0.0, 1.0)}
    a, b = spark.createDataFrame(
        [(0, "x", 1), (1, "y", 2)], "at int, u string, p int",
    ), spark.createDataFrame([(0, "x", 5), (1, "y", 6)], "at int, u string, d int")
    assert sorted((r.u, r.p, r.d) for r in sinks.paired(a, b, "u", "at").collect()) == [("x", 1, 5), ("y", 2, 6)]
    for wrong in (b.limit(1), b.withColumn("u", F.lit("x"))):
        with pytest.raises(Exception, match="fit together"):
            sinks.paired(a, wrong, "u", "at").collect()


def test_audio_formats():
    import wave

    from lyrebird.sources import archives

    for width, scale in ((1, 1 << 7), (2, 1 << 15), (3, 1 << 23), (4, 1 << 31)):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(width), w.setframerate(16_000)
            values = [0, scale // 2, -scale // 2, -scale]
            w.writeframes(
                b"".join((v + 128 if width == 1 else v).to_bytes(width, "little", signed=width > 1) for v in values)
            )
        assert archives.samples(out.getvalue()).tolist() == [0, 0.5, -0.5, -1]
    with pytest.raises(ValueError, match="soundfile"):
        archives.samples(b"ID3 not a wave file")
