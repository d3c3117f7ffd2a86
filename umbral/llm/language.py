"""Language of pages and documents: text, declared language, address suffix and host, by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.llm.common import materialise, text_of
from umbral.llm.tokens import slices

#: Letter trigrams are counted in so many cells for each language.
CELLS = 1 << 15
#: Trigrams of one text overlap and repeat: its likelihood counts by this power.
POWER = 0.1
#: Weight of the level above in a smoothed prior: global, then suffix, domain, host.
ALPHA = 4.0
#: Below this posterior, or without any letter, a language is undetermined.
LEAST = 0.5
#: Bytes of text that are worked on at once, a single text aside.
SLICE = 1 << 20
UNDETERMINED = "und"


def _cells(texts: Sequence[str]):
    """Cells of all letter trigrams of some texts, and the number of them before each text.

    Every text has a space on either side, so its cells do not depend on the texts around it.
    """
    import numpy as np

    low = [t.lower() for t in texts]
    points = np.frombuffer(f" {' '.join(low)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low], dtype=np.int64)
    letter = ((points >= 97) & (points <= 122)) | (points >= 170)
    c = np.where(letter, points, 32).astype(np.uint32)
    mixed = c[:-2] * np.uint32(2654435761) + c[1:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    keep = letter[1:-1]
    before = np.concatenate([[0], np.cumsum(keep)])
    at = np.concatenate([[0], ends - 1])
    return (mixed[keep] & np.uint32(CELLS - 1)).astype(np.int64), before[at]


def _count(batches: Iterator) -> Iterator:
    """Counts of trigrams by language over a whole partition; a language has ``CELLS`` numbers."""
    import numpy as np
    import pyarrow as pa

    totals: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, size=SLICE):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = np.array(batch.column("text").to_pylist(), object)
            for lang in set(langs.tolist()):
                cells, _ = _cells(texts[langs == lang].tolist())
                counts = np.bincount(cells, minlength=CELLS)
                totals[lang] = totals[lang] + counts if lang in totals else counts
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "cell", "n"])


def text_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list]:
    """Languages, and log probabilities of the cells for each, from all labelled texts.

    Rows without a language say nothing. The model has ``CELLS`` numbers for each language.
    """
    import numpy as np

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counts})
    table = np.full((len(langs), CELLS), 0.5)
    where = {lang: i for i, lang in enumerate(langs)}
    for r in counts:
        table[where[r["lang"]], r["cell"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(model):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, size=SLICE):
                cells, at = _cells(batch.column("text").to_pylist())
                sums = np.empty((batch.num_rows, len(model)))
                for i, row in enumerate(model):
                    total = np.concatenate([[0.0], np.cumsum(row[cells], dtype=np.float64)])
                    sums[:, i] = total[at[1:]] - total[at[:-1]]
                flat = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, len(model), dtype=np.int32), sums.ravel())
                yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns) if n != "text"], flat, pa.array(np.diff(at))], names=[*[n for n in batch.schema.names if n != "text"], "text_log", "n_letters"])

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)


def fuse(rows: DataFrame, langs: list[str], alpha: float = ALPHA, power: float = POWER, least: float = LEAST) -> DataFrame:
    """Posterior language of rows with ``text_log``, ``n_letters``, ``declared``, ``host``, ``domain``, ``suffix``.

    The most likely language of each text is counted by host, domain, suffix and declared language.
    A host's prior is smoothed towards its domain's, that towards its suffix's, that towards the global
    one; a row's own count is taken out at each level. The declared language and the suffix speak by
    how often they go with each language.
    """
    size = len(langs)
    zero = F.array(*[F.lit(0.0)] * size)
    top = F.array_position("text_log", F.array_max("text_log")).cast("int") - 1
    rows = materialise(rows.withColumn("own", F.when(F.col("n_letters") > 0, top).otherwise(F.lit(-1))))
    # what speaks beside the text is the same for all rows of a combination, and worked out once for it
    known = ["host", "declared", "own"]
    combined = rows.groupBy(*known, "domain", "suffix").agg(F.count(F.lit(1)).cast("double").alias("n_rows"))
    each = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == F.col("own"), F.col("n_rows")).otherwise(F.lit(0.0)))
    combined = materialise(combined.withColumn("one", each))

    def counted(keys: list[str], name: str, table: DataFrame) -> DataFrame:
        sums = [F.sum(F.col("one")[i]).alias(f"s{i}") for i in range(size)]
        return table.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"s{i}") for i in range(size)]).alias(name))

    hosts = materialise(counted(["host", "domain", "suffix"], "by_host", combined))
    above = hosts.withColumnRenamed("by_host", "one")
    hosts = hosts.join(counted(["domain", "suffix"], "by_domain", above), ["domain", "suffix"]).join(counted(["suffix"], "by_suffix", above), ["suffix"])
    total = F.broadcast(above.agg(F.array(*[F.coalesce(F.sum(F.col("one")[i]), F.lit(0.0)) for i in range(size)]).alias("by_all")))
    declared = counted(["declared"], "by_declared", combined)

    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    less = lambda xs: F.zip_with(xs, F.sequence(F.lit(0), F.lit(size - 1)), lambda a, i: F.greatest(a - (i == F.col("own")).cast("double"), F.lit(0.0)))

    def smooth(counts: Column, prior: Column) -> Column:
        return F.zip_with(counts, prior, lambda n, p: (n + F.lit(alpha) * p) / (add(counts) + F.lit(alpha)))

    def spoken(counts: Column, all_: Column, share: Column) -> Column:
        """log P(evidence | language), smoothed towards the evidence's overall share."""
        return F.zip_with(counts, all_, lambda n, m: F.log((n + F.lit(alpha) * share) / (m + F.lit(alpha))))

    joined = combined.join(hosts, ["host", "domain", "suffix"]).join(declared, "declared").crossJoin(total)
    for level in ("host", "domain", "suffix", "declared", "all"):
        joined = joined.withColumn(f"by_{level}", less(F.col(f"by_{level}")))
    joined = joined.withColumn("p_all", F.transform("by_all", lambda n: (n + 1.0) / (add(F.col("by_all")) + float(size))))
    for level, over in (("suffix", "all"), ("domain", "suffix"), ("host", "domain")):
        joined = joined.withColumn(f"p_{level}", smooth(F.col(f"by_{level}"), F.col(f"p_{over}")))
    share = lambda counts: (add(counts) + 1.0) / (add(F.col("by_all")) + 2.0)
    logs = F.transform("p_host", lambda p: F.log(p))
    logs = F.zip_with(logs, F.when(F.col("declared") == "", zero).otherwise(spoken(F.col("by_declared"), F.col("by_all"), share(F.col("by_declared")))), lambda a, b: a + b)
    logs = F.zip_with(logs, F.when(F.col("suffix") == "", zero).otherwise(spoken(F.col("by_suffix"), F.col("by_all"), share(F.col("by_suffix")))), lambda a, b: a + b)
    evidence = materialise(joined.select(*known, logs.alias("evidence")))
    names = F.array(*[F.lit(x) for x in langs])
    logs = F.zip_with("text_log", "evidence", lambda x, e: x * F.lit(power) + e)
    joined = rows.join(evidence, known).withColumn("logs", logs)
    scored = joined.withColumn("posteriors", _softmax(F.col("logs"))).withColumn("posterior", F.array_max("posteriors"))
    best = F.element_at(names, F.array_position("posteriors", F.col("posterior")).cast("int"))
    sure = (F.col("posterior") >= least) & (F.col("n_letters") > 0)
    return scored.select(
        "id", F.when(sure, best).otherwise(F.lit(UNDETERMINED)).alias("lang"), "posterior",
        F.when(F.col("own") >= 0, F.element_at(names, F.col("own") + 1)).alias("text_lang"), "declared", "host", "n_letters",
    )


def _host_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels) and address suffix (the last label)."""
    return F.substring_index(host, ".", -2), F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def visible_text(html: Column) -> Column:
    """Text of a page: comments, scripts, styles and tags are spaces, entities too."""
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(body, r"<[^>]*>|&#?\w+;", " ")


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Language of each page from its text, its ``lang`` attribute, and the host and suffix of its address.

    Null or empty pages have no letters and are undetermined, whatever else is known; a missing
    attribute or address is a value of its own. Repeated rows are rows of their own. Without labelled
    texts every page is undetermined.
    """
    html, url = text_of("html"), F.lower(text_of("url"))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    declared = F.substring_index(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)), "-", 1)
    return _identify(pages.select(F.col("page_id").alias("id"), declared.alias("declared"), host.alias("host"), visible_text(html).alias("text")), labelled)


def identify_documents(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fitted: tuple | None = None) -> DataFrame:
    """Language of each document; its ``lang`` is the declared language and its source stands for a host.

    ``fitted`` is the ``text_model`` of ``labelled`` where the caller has it already.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_of(lang_col)).alias("declared"), F.lower(text_of(source_col)).alias("host"), text_of(text_col).alias("text"))
    return _identify(rows, labelled, fitted)


def _identify(rows: DataFrame, labelled: DataFrame, fitted: tuple | None = None) -> DataFrame:
    langs, model = fitted or text_model(labelled)
    if not langs:
        langs, model = [UNDETERMINED], model if len(model) else [[0.0] * CELLS]
        import numpy as np

        model = np.array(model, np.float32)
    id_type = dict(rows.dtypes)["id"]
    schema = f"id {id_type}, declared string, host string, text_log array<double>, n_letters long"
    scored = rows.mapInArrow(_score(model), schema)
    domain, suffix = _host_parts(F.col("host"))
    return fuse(scored.withColumn("domain", domain).withColumn("suffix", suffix), langs)


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """Documents whose language is known; the text model comes from their own declared languages.

    A document is rejected when it holds no letter or no language reaches ``LEAST``. Each row is judged
    by its own text, declared language and source, whatever its id. Where no row with a letter declares
    a language, there is no model to tell languages by, and only documents without a letter are rejected.
    """
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in ("doc_id", "lang", "source")], F.sha2(text_of("text").cast("binary"), 256)))
    langs, model = text_model(docs)
    found = identify_documents(docs.withColumn("doc_id", key), docs, fitted=(langs, model))
    unknown = F.col("lang") == UNDETERMINED if langs else F.col("n_letters") == 0
    rejected = found.where(unknown).select(F.col("id").alias("key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    return rows.join(rejected, "key", "left_anti").select("row.*")
