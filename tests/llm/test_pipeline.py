import os
import random
import re
import subprocess
import sys

from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from edge import CLASHES, SCHEMA, labels, words
from pyspark.sql import functions as F
from test_ngram_join import FOLD
from test_ngram_join import expected as near_groups

import corpus_pipeline
from tributary.llm import queries
from tributary.llm.exact_dedup import exact_dedup
from tributary.llm.mixing import fit_classifier, memberships
from tributary.llm.ngram_join import ngram_join
from tributary.llm.toxicity import fit
from tributary.sources.staging import staged

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        kept.append(after.count())
        if name != names[-1]:
            assert after.columns == docs.columns
        if name == "exact_dedup":
            assert exact_dedup(after).where("not kept").count() == 0 and kept[-1] < kept[-2]
        if name == "ngram_jaccard_join":
            assert ngram_join(after).where("doc_id <> component_id").count() == 0
        if name == "mixing":
            assert after.select("doc_id").distinct().count() == before.count()
        before = after
    assert corpus_pipeline.run(spark, SF).count() == kept[-1]


def test_stages_on_odd_rows_against_plain_versions(spark, odd, odd_rows, tmp_path):
    """Nulls, ties, repeats, ids that are missing and clashing names through every stage; which rows stay, by brute force."""
    sf = str(tmp_path)
    rng = random.Random(4)
    more = [(1000 + i, words(rng, 12, 10**6) + (" you blackguard" if i < 60 else ""), "en", "hot", 0) for i in range(120)]
    marks = [(i, i % 3 and 1, 0) for i in range(0, 90)] + [(3, None, None), (None, 1, 1)] + [(1000 + i, 1, int(i < 60)) for i in range(120)]
    frame = spark.createDataFrame(odd_rows + more, SCHEMA)
    clashing = frame.select("*", *(F.lit("clash").alias(c) for c in CLASHES))
    clashing.repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels(spark, marks).write.parquet(f"{sf}/labels.parquet")
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    plain = lambda some: Counter((r.doc_id, r.text, r.lang, r.source) for r in some.collect())
    now, stages = docs_, dict(corpus_pipeline.STAGES)

    model = fit(now, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = staged(stages["toxicity"](spark, now, sf))
    assert plain(kept) == Counter({k: n for k, n in plain(now).items() if model.score(k[1]) < 0.5}) and kept.count() < now.count()
    now = kept

    kept, groups = staged(stages["exact_dedup"](spark, now, sf)), {}
    for i, t, *_ in plain(now):
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert plain(kept) == Counter({k: n for k, n in plain(now).items() if k[0] == best[(k[1] or "").translate(FOLD)]})
    now = kept

    kept = staged(stages["ngram_jaccard_join"](spark, now, sf))
    rows = list(plain(now).elements())
    stay = {i for i, _, least in near_groups(rows) if i == least}
    assert plain(kept) == Counter(r for r in rows if r[0] in stay) and kept.count() < now.count()
    now = kept

    kept = staged(stages["mixing"](spark, now, sf))
    assert kept.columns == docs_.columns and set(plain(kept)) == set(plain(now)) and not plain(now) - plain(kept)
    now = kept

    model_path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    last = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in stages["sentencepiece"](spark, now, sf).collect())
    expected = Counter()
    for (i, t, *_), n in plain(now).items():
        ids = library.encode(t or "")
        expected[i, len(ids), tuple(ids), library.decode(ids)] += n
    assert last == expected


def test_stages_of_an_empty_table(spark, none, tmp_path):
    sf = str(tmp_path)
    none.write.parquet(f"{sf}/documents.parquet")
    labels(spark, []).write.parquet(f"{sf}/labels.parquet")
    now = none
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0 and (name == "sentencepiece" or now.columns == none.columns)


def test_the_last_stage_decodes(spark):
    frame = spark.createDataFrame([(1, "One two  three, ñ 中文"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in corpus_pipeline.encoding(spark, frame, SF).collect()}
    assert {i: r.decoded for i, r in got.items()} == {1: "One two  three, ñ 中文", 2: "", 3: ""}
    assert all(len(r.ids) == r.n_tokens for r in got.values())


def test_mixing_moves_the_shares_of_tokens(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = frame.join(marks.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select(frame.columns).cache()
    mixed = corpus_pipeline.mixing(spark, kept, "/root/testdata/sf0.01")
    classifier = fit_classifier(kept, marks, F.expr(queries.DOMAIN))

    def shares(some):
        rows = memberships(some, classifier).toPandas()
        sums = (np.stack(rows.posterior) * rows.n_tokens.to_numpy()[:, None]).sum(axis=0)
        return dict(zip(classifier.domains, sums / sums.sum(), strict=True))

    natural, reached = shares(kept), shares(mixed)
    assert classifier.domains == ["clean", "poor"]
    assert natural["clean"] > 7 / 9 + 0.08 and abs(reached["clean"] - 7 / 9) < 0.02


def test_queries_are_registered_and_unlimited():
    found = [n for n in queries.QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))


def test_the_rest_stands_without_this_part(tmp_path):
    """The entry still imports when the subpackage and the pipeline are gone, and raises on other import errors."""
    root = os.path.dirname(corpus_pipeline.__file__)
    code = """
import sys
class Gone:
    def find_spec(self, name, *rest):
        if name == "corpus_pipeline" or name.startswith("tributary.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "anti_set" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_nothing_else_imports_this_part():
    root = os.path.dirname(corpus_pipeline.__file__)
    for folder, _, files in os.walk(os.path.join(root, "tributary")):
        for name in files:
            if name.endswith(".py") and "llm" not in folder.split(os.sep):
                assert not re.search(r"\bllm\b|corpus_pipeline", open(os.path.join(folder, name)).read()), name
