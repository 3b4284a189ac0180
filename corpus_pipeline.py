"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, then BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; ``run`` writes a stage's rows as
Parquet in the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import common, decontaminate, distinct_bpe, minhash_dedup, quality_rules, substring_dedup
from weftline.llm.queries import tokenizer_file


def _numbered(docs):
    """The rows of docs with columns c0, c1 and so on, so that no name can clash with those of an operator, and the new names by the old."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def _carried(names):
    """The numbered columns that an operator has to carry: not those that ``_documents`` replaces, or every text would travel twice."""
    return tuple(n for x, n in names.items() if x not in ("text", "n_chars"))


def _documents(docs, changed, text: str):
    """Rows of an operator that carried the numbered columns, as documents; ``text`` is the column that holds the new text."""
    _, names = _numbered(docs)
    new = {"text": F.col(text), "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return changed.select(*(new.get(x, F.col(n)) for x, n in names.items())).toDF(*docs.columns)


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    rows, names = _numbered(docs)
    judged = quality_rules.quality_rules(rows, id_col=names["doc_id"], text_col=names["text"], lang_col=names["lang"], carry=tuple(names.values()))
    return judged.where("kept").select(*names.values()).toDF(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays, that with the smallest doc_id, or any one if none has a doc_id; rows that repeat it go too.

    A document is known by its doc_id and text, as ids may be null or repeated. Texts without words are in no group and stay.
    """
    rows, names = _numbered(docs)
    made = minhash_dedup.grouped(docs.select("doc_id", "text"))
    groups = common.saved(made, "groups")
    common.forget(made)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha")
    first = groups.where("component is not null").groupBy("component").agg(F.min(order).alias("x")).select("x.doc_id", "x.text_sha", F.lit(False).alias("alone"))
    alone = groups.where("component is null").select("doc_id", "text_sha", F.lit(True).alias("alone")).distinct()
    key = ["id", "none", "sha"]
    known = lambda x, i, sha: x.withColumn("id", F.coalesce(F.col(i).cast("long"), F.lit(0))).withColumn("none", F.col(i).isNull()).withColumn("sha", F.coalesce(sha, F.lit(b"")))
    kept = known(first.union(alone), "doc_id", F.col("text_sha")).select(*key, "alone")
    # without an id, copies of one text are one key
    copies = known(groups.where("doc_id is null"), "doc_id", F.col("text_sha")).groupBy(*key).agg(F.count("*").alias("n"))
    i, text = names["doc_id"], names["text"]
    rows = common.skew_join(known(rows, i, minhash_dedup.text_sha(F.col(text))), kept, key, copies, groups.count(), list(names.values()))
    # equal texts without words and without a doc_id repeat nothing
    rows = rows.withColumn("own", F.when(F.col("alone") & F.col("none"), F.monotonically_increasing_id()))
    # by the join's own keys, so that texts are not exchanged again
    return rows.dropDuplicates([*key, "own"]).select(*names.values()).toDF(*docs.columns)


def repeats(spark, docs, sf_dir):
    """Stretches that repeat those of a document with a smaller doc_id are cut out of the text."""
    rows, names = _numbered(docs)
    return _documents(docs, substring_dedup.remove_repeats(rows, id_col=names["doc_id"], text_col=names["text"], carry=_carried(names)), "kept_text")


def benchmark_passages(spark, docs, sf_dir):
    """Words that lie in a benchmark window are cut out of the text."""
    rows, names = _numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _documents(docs, decontaminate.decontaminate(rows, benchmark, id_col=names["doc_id"], text_col=names["text"], carry=_carried(names)), "clean_text")


def tokens(spark, docs, sf_dir):
    """Token counts and digests of what is left."""
    return distinct_bpe.encode_decode(docs, tokenizer_file(), texts=False)


STAGES = [("quality_rules", quality), ("minhash_dedup", near_dedup), ("substring_dedup", repeats), ("decontaminate", benchmark_passages), ("distinct_bpe", tokens)]

#: SQL has no byte-level BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
