"""The rows kept by each stage of the pipeline against plain Python, on made-up documents."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillbook.llm import contamination, mixing, near, quality
from tillbook.llm.registry import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def written(df, folder):
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def linked(a, b):
    x, y = ({*zip(w, w[1:])} for w in (a.split(), b.split()))
    return 100 * len(x & y) >= 80 * len(x | y)


def test_stages_keep_what_plain_python_keeps(spark, tmp_path):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(random.choices(vocabulary, k=80)) for _ in range(30)]
    texts += [texts[0], texts[1] + " more", "few words", "a b c " * 40, None]
    item = " ".join(random.choices(vocabulary, k=12))
    texts += [f"{' '.join(random.choices(vocabulary, k=60))} {item}"]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    # Ten trusted documents of the same words are no evidence against any of the others.
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    good = {i for i, t in enumerate(texts) if len(WORD.findall(t or "")) >= 50 and t != "a b c " * 40}
    first = {i for i in good if not any(j < i and linked(texts[j], texts[i]) for j in good)}
    clean = {i for i in first if not any(" ".join(item.split()[k : k + 10]) in texts[i] for k in range(3))}
    assert len(texts) > len(good) > len(first) > len(clean)

    # What the first stage did with even smoothing.
    even = {r.doc_id for r in quality.quality_rules(docs, labels).filter("kept").collect()}
    assert even < good
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], (good, first, clean)):
        docs = written(stage(spark, docs, folder), f"{folder}/{name}")
        assert Counter(r.doc_id for r in docs.collect()) == Counter(want), name
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    times = {r.doc_id: r.times for r in mixing.mixed(docs).collect()}
    docs = written(corpus_pipeline.STAGES[3][1](spark, docs, folder), f"{folder}/mixed")
    got = Counter(r.doc_id for r in docs.collect())
    assert got == Counter({i: n for i, n in times.items() if n})
    # All words are dealt out, up to a document a source.
    dealt = sum(n * len(WORD.findall(texts[i])) for i, n in got.items())
    assert abs(dealt - sum(len(WORD.findall(texts[i])) for i in clean)) <= 2 * 80
    want_mix = plain_mix([(i, texts[i], "ab"[i % 2]) for i in sorted(clean)])
    assert times == want_mix
    rows = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in rows) == got
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == token_rows([(i, texts[i]) for i in got.elements()])


def token_rows(rows):
    """What the tokenizer gives for whole texts: id, tokens with the end id, crc32 of the ids."""
    coder = Tokenizer.from_file(tokenizer_path())
    out = []
    for i, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def plain_mix(rows):
    """How often each document is taken: targets by filling up evenly, thresholds by sorting hashes."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows})
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    open_names, left, target = set(names), sum(total.values()), {}
    while open_names:
        level = left / sum(weight[s] for s in open_names)
        full = {s for s in open_names if weight[s] * level > 3 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_names}
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
        open_names -= full
    times = {}
    for s in names:
        whole = int(target[s] // total[s])
        rest = target[s] - whole * total[s]
        mine = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i) for i, _, x in rows if x == s)
        chosen, upto = set(), 0
        for _, i in mine:
            # The document that crosses the budget is taken if that comes nearer to it.
            if abs(upto + size[i] - rest) < abs(upto - rest):
                chosen.add(i)
                upto += size[i]
            else:
                break
        times |= {i: whole + (i in chosen) for _, i in mine}
    return times


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def small_tables(spark, folder):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "q w e r t z u i o p a")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_an_empty_table_goes_through_all_stages(spark, tmp_path):
    folder = str(tmp_path)
    small_tables(spark, folder)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.collect() == []


def test_nulls_and_repeated_rows_go_through_all_stages(spark, tmp_path):
    folder = str(tmp_path)
    small_tables(spark, folder)
    random.seed(8)
    texts = [" ".join(random.choices([f"v{i}" for i in range(400)], k=70)) for _ in range(6)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] * 2
    rows += [(None, texts[0], None, None, None), (7, None, None, None, None), (None, None, None, None, None)]
    rows += [(8, texts[5] + " q w e r t z u i o p", "en", None, 0), (9, "", "", "", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, folder), f"{folder}/{name}")
    # Rows repeated in full come once, and an id is needed to be a copy; 8 is a near copy of 5.
    assert Counter(r.doc_id for r in docs.collect()) == Counter([None, *range(6)])
    out = corpus_pipeline.run(spark, folder).collect()
    # The mix may leave out documents of a source that weighs little.
    assert {r.doc_id for r in out} <= {None, *range(6)} and len(out) > 3
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:]))


# Columns that the stages use inside, and results they add.
NAMES = [
    "_hash", "_source", "Size", "_times", "_below", "_row", "size", "times", "_k1", "_K2", "_bits", "hits", "_mark",
    "rep", "print", "_copy", "kept", "n_words", "_words", "weights", "bucket", "row", "d", "M", "target", "_trusted",
]


def test_further_columns_of_any_name_pass_through(spark, tmp_path):
    folder = str(tmp_path)
    small_tables(spark, folder)
    random.seed(9)
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(random.choices(words, k=70)), "en", "ab"[i % 2], 1) for i in range(8)]
    rows.append((8, "q w e r t z u i o p " + " ".join(random.choices(words, k=70)), "en", "a", 1))
    rows.append((9, rows[0][1], "en", "b", 1))
    plain = spark.createDataFrame(rows, SCHEMA)
    more = ", ".join(f"`{n}` string" for n in NAMES if n != "Size")
    wide = spark.createDataFrame([(*r, *["own"] * (len(NAMES) - 1)) for r in rows], f"{SCHEMA}, {more}")
    for name, stage in corpus_pipeline.STAGES:
        narrow = [tuple(r) for r in stage(spark, plain, folder).collect()]
        assert sorted(map(str, narrow)) == sorted(map(str, [tuple(r) for r in stage(spark, wide, folder).collect()])), name
    for own in (near.first_copies(wide), mixing.repeated(wide), contamination.without_leaks(wide, spark.read.parquet(f"{folder}/benchmark.parquet"))):
        assert own.columns == wide.columns
        assert {r["size"] for r in own.collect()} == {r["_k1"] for r in own.collect()} == {"own"}
    capital = plain.withColumn("Size", F.lit("own"))
    assert {r["Size"] for r in mixing.repeated(capital).collect()} == {"own"}
