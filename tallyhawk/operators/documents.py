"""Document operators: A13 blocks from a text table, A15 invoice sentences,
A16 file-type gate, I1 cleaning, I2 section packing, I3 page blocks,
I4 chunking, I5 index summary, I8–I11 answer extraction.

Everything is a per-row projection or explode; the only aggregates are the
index summary (global counts, partial) and the answer pick per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.functions import vocab
from tallyhawk.session import materialize

# fixed values
CHUNK_SIZE = 700
CHUNK_OVERLAP = 120
SECTION_LIMIT = 1200
FALLBACK_CHARS = 220
SEARCH_K = 8
SEARCH_MIN_SCORE = 0.20
SEARCH_REPORT = 5
SUMMARY_TYPES = ["pdf", "docx", "pptx", "txt", "md", "csv", "xlsx", "xls"]
NO_INDEX_ANSWER = "No indexed documents available."
NO_MATCH_ANSWER = ("No strong answer found in the uploaded documents. Try asking with exact SAP "
                   "terms like tax procedure, pricing procedure, company code, vendor group, MIRO, "
                   "OBYC, or tolerance key.")

_WS = r"(?U)^\s+|\s+$"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, _WS, "")


def _let(value: Column, body) -> Column:
    """``body`` of a value computed once: a lambda computes what it names from outside again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- A13 / A15 / A16 --------------------------------------------------------------

def document_blocks(docs: DataFrame, text="text", file_name="source", location: str | None = None,
                    doc_type: str | None = None) -> DataFrame:
    """A document table as blocks (doc_id, file_name, location, doc_type, text).

    ``location`` and ``doc_type`` name columns that hold them; without them a document is one page, and its type is
    the extension of its file name (``txt`` without one)."""
    ext = F.lower(F.regexp_extract(F.col(file_name), r"\.([^./]+)$", 1))
    kind = F.when(F.coalesce(ext, F.lit("")) == "", F.lit("txt")).otherwise(ext)
    return docs.select("doc_id", F.col(file_name).alias("file_name"),
                       (F.col(location) if location else F.lit("Page 1")).alias("location"),
                       (F.col(doc_type) if doc_type else kind).alias("doc_type"),
                       F.col(text).alias("text"))


def row_sentences(df: DataFrame) -> DataFrame:
    """One sentence per invoice row from its text values; an absent column
    gives empty text, a missing value the text 'nan'."""
    def v(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("nan")) if name in df.columns else F.lit("")
    return df.withColumn("sentence", F.concat(
        F.lit("Invoice "), v("InvoiceNumber"), F.lit(" from "), v("Vendor"), F.lit(" dated "),
        v("InvoiceDate"), F.lit(" amount "), v("Amount"), F.lit(" "), v("Currency"),
        F.lit(" has status "), v("PaymentStatus"), F.lit(".")))


def file_type_gate(files: DataFrame, name_col: str = "file_name",
                   supported: list[str] = SUMMARY_TYPES) -> DataFrame:
    """Last extension (lower case) and whether it is supported."""
    n = F.col(name_col)
    ext = F.when(n.contains("."), F.lower(F.regexp_extract(n, r"\.([^.]*)$", 1))).otherwise(F.lit(""))
    return files.withColumn("ext", ext).withColumn("supported", F.col("ext").isin(*supported))


# ---- I1–I3 ------------------------------------------------------------------------------

def clean_text(c: Column) -> Column:
    """Nbsp → space, CR → LF, 3+ LF → 2, runs of blanks/tabs → one space, strip."""
    t = F.regexp_replace(c, " ", " ")
    t = F.regexp_replace(t, "\r", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    return py_strip(t)


def section_blocks(docs: DataFrame, text="text") -> DataFrame:
    """Paragraphs (lines) are cleaned and buffered; once the buffer joined by
    spaces is longer than 1,200 characters it becomes a block 'Section n'; the
    last partial buffer is a block too. One fold per document (JVM-side)."""
    paras = F.transform(F.split(F.col(text), "\n"), lambda p: clean_text(p))
    init = F.struct(F.array().cast("array<string>").alias("done"),
                    F.array().cast("array<string>").alias("buf"),
                    F.lit(0).alias("blen"))

    def step(acc, p):
        nonempty = F.length(p) > 0
        buf = F.when(nonempty, F.concat(acc["buf"], F.array(p))).otherwise(acc["buf"])
        blen = F.when(nonempty, acc["blen"] + F.length(p)
                      + F.when(F.size(acc["buf"]) > 0, 1).otherwise(0)).otherwise(acc["blen"])
        full = blen > SECTION_LIMIT
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(buf, "\n")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(buf).alias("buf"),
            F.when(full, F.lit(0)).otherwise(blen).alias("blen"))

    def finish(acc):
        return F.when(F.size(acc["buf"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["buf"], "\n")))) \
                .otherwise(acc["done"])

    blocks = F.aggregate(paras, init, step, finish)
    return (docs.select("*", F.posexplode(blocks).alias("_pos", "_block"))
                .withColumn("location", F.concat(F.lit("Section "), (F.col("_pos") + 1).cast("string")))
                .withColumn("block_text", F.col("_block")).drop("_pos", "_block"))


def read_text_documents(spark, path: str, refuse_invalid: bool = False) -> DataFrame:
    """A14 + I26: a folder of plain-text files as (file_name, text, error), one row per
    file. Bytes that are not UTF-8 become U+FFFD; with ``refuse_invalid`` such a file
    keeps its row without text, and an error says why, so that the others are not
    held up. Spark's reader leaves out empty files."""
    files = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    error = F.when(F.lit(refuse_invalid) & ~F.is_valid_utf8(text), F.lit("Error: the file is not valid UTF-8 text"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), error.alias("error"), F.make_valid_utf8(text).alias("text")) \
        .select("file_name", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def require_supported(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """A16 for an upload: the supported files; an error if there is none."""
    kept = file_type_gate(files, name_col).where("supported")
    if not kept.limit(1).count():
        raise ValueError("None of the files has a supported type: " + ", ".join(SUMMARY_TYPES))
    return kept


def page_blocks(docs: DataFrame, text="text", unit: str = "Page") -> DataFrame:
    """One block per page (form feed separates pages), empty pages skipped,
    located 'Page n' with n counting every page; ``unit="Slide"`` for slides."""
    return (docs.select("*", F.posexplode(F.split(F.col(text), "\f")).alias("_pos", "_page"))
                .withColumn("block_text", clean_text(F.col("_page")))
                .where(F.length("block_text") > 0)
                .withColumn("location", F.concat(F.lit(f"{unit} "), (F.col("_pos") + 1).cast("string")))
                .drop("_pos", "_page"))


# ---- I4–I5: chunks ---------------------------------------------------------------------

def chunk_array(c: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """I4 as an array: windows of ``size`` every ``size - overlap`` characters until
    the end is reached, each stripped, empty pieces dropped."""
    step = size - overlap

    def pieces(t):
        n = F.length(t)
        last = F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(step))).cast("int")
        if overlap > step:
            cut = F.transform(F.sequence(F.lit(0), last), lambda s: F.substring(t, s * step + 1, size))
        else:   # a window is a step and the head of the next one: the text is read once, not once a window
            cut = _let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), lambda steps: F.slice(
                F.zip_with(steps, F.slice(steps, 2, F.size(steps)), lambda a, b: F.concat(
                    a, F.coalesce(F.substring(b, 1, overlap), F.lit("")))), 1, last + 1))
        return F.when(n == 0, F.array().cast("array<string>")) \
                .when(n <= size, F.array(t)) \
                .otherwise(F.filter(F.transform(cut, py_strip), lambda p: F.length(p) > 0))
    return F.coalesce(_let(py_strip(c), pieces), F.array().cast("array<string>"))


def build_chunks(blocks: DataFrame, text="text") -> DataFrame:
    """I4: one row per chunk with ``chunk_id`` from 1 within each block."""
    return (blocks.select(*[c for c in blocks.columns if c != text],
                          F.posexplode(chunk_array(F.col(text))).alias("_pos", "chunk_text"))
                  .withColumn("chunk_id", (F.col("_pos") + 1).cast("int")).drop("_pos"))


def index_summary(chunks: DataFrame) -> DataFrame:
    """Per file its chunk count, with the totals on every row (no file list
    is gathered into one row)."""
    per_file = chunks.groupBy("file_name").agg(F.count(F.lit(1)).alias("file_chunks"))
    totals = per_file.agg(F.count(F.lit(1)).alias("total_files"),
                          F.sum("file_chunks").alias("total_chunks"))
    return per_file.crossJoin(F.broadcast(totals))  # totals is one row


# ---- I8–I11: answers ----------------------------------------------------------------------

def collapse_ws(c: Column) -> Column:
    """' '.join(text.replace('\\n', ' ').split())."""
    return py_strip(F.regexp_replace(F.regexp_replace(c, "\n", " "), r"(?U)\s+", " "))


def _first(pattern: str, t: Column, group: int = 1) -> Column:
    """First match group of a case-insensitive pattern, or null."""
    rx = "(?i)" + pattern
    return F.when(t.rlike(rx), py_strip(F.regexp_extract(t, rx, group)))


def direct_answer(query: Column, text: Column, collapsed: bool = False) -> Column:
    """I8: the first matching pattern family chosen by words in the query.
    ``collapsed``: white space in ``text`` is collapsed already."""
    q = F.lower(query)
    t = text if collapsed else collapse_ws(text)
    tl = F.lower(t)
    # cheap necessary conditions first: the lazy '.*?' patterns are quadratic
    tax = F.when(tl.contains("tax"), F.coalesce(_first(vocab.DIRECT_PATTERNS["tax"][0], t),
                                                _first(vocab.DIRECT_PATTERNS["tax"][1], t)))
    pricing = F.coalesce(_first(vocab.DIRECT_PATTERNS["pricing"][0], t),
                         _first(vocab.DIRECT_PATTERNS["pricing"][1], t))
    threshold = F.when(tl.contains("inr") | tl.contains("usd"),
                       F.coalesce(_first(vocab.DIRECT_PATTERNS["threshold"][0], t), _first(vocab.DIRECT_PATTERNS["threshold"][1], t)))
    has_groups = tl.contains("domestic") & tl.contains("import")
    dom = F.when(has_groups, _first(vocab.DIRECT_PATTERNS["groups"][0], t))
    imp = F.when(has_groups, _first(vocab.DIRECT_PATTERNS["groups"][1], t))
    groups = F.when(dom.isNotNull() & imp.isNotNull(),
                    F.concat(F.lit("Domestic: "), dom, F.lit("; Import: "), imp))

    def two(pattern):
        rx = "(?i)" + pattern
        return F.when(t.rlike(rx), F.concat_ws(" | ", py_strip(F.regexp_extract(t, rx, 1)),
                                               py_strip(F.regexp_extract(t, rx, 2))))
    tolerance = F.when(tl.contains("percent"),
                       F.coalesce(two(vocab.DIRECT_PATTERNS["tolerance"][0]),
                                  two(vocab.DIRECT_PATTERNS["tolerance"][1])))
    terms = F.coalesce(_first(vocab.DIRECT_PATTERNS["terms"][0], t), _first(vocab.DIRECT_PATTERNS["terms"][1], t))
    posting = F.when(t.rlike(vocab.DIRECT_PATTERNS["posting"][0]) & t.rlike(vocab.DIRECT_PATTERNS["posting"][1]),
                     F.lit(vocab.DIRECT_TEXTS["posting"]))
    amt = F.when(tl.contains("inr"), _first(vocab.DIRECT_PATTERNS["threshold"][0], t))
    three_way = F.when(amt.isNotNull(), F.concat(F.lit("Yes, above "), amt))
    lesson = (F.when(tl.contains("error instead of warning"),
                     F.lit(vocab.DIRECT_TEXTS["error"]))
               .when(tl.contains("duplicate invoice prevention improved"),
                     F.lit(vocab.DIRECT_TEXTS["prevention"])))
    return (F.when(q.contains("tax procedure"), tax)
             .when(q.contains("pricing procedure"), pricing)
             .when(q.contains("approval threshold") | q.contains("high value invoice approval threshold"),
                   threshold)
             .when(q.contains("vendor account groups") | q.contains("account groups"), groups)
             .when(q.contains("tolerance key"), tolerance)
             .when(q.contains("payment terms"), terms)
             .when(q.contains("obyc") | q.contains("gr/ir") | q.contains("inventory posting"), posting)
             .when(q.contains("three-way match"), three_way)
             .when(q.contains("duplicate invoice") & (q.contains("resolution") | q.contains("prevention")
                                                       | q.contains("lesson")), lesson))


def fallback_answer(text: Column, limit: int = FALLBACK_CHARS) -> Column:
    """Cleaned text; longer than ``limit`` → first ``limit`` characters cut
    back to the last space, plus '...'."""
    t = collapse_ws(text)
    head = F.substring(t, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("...")))


def answer_queries(matches: DataFrame) -> DataFrame:
    """I9 + I11 over ranked matches (query_id, query, rank, text, file_name, location):
    the best match's direct answer, else the first of ranks 2–4 with one, else the
    fallback of the best match; with its source line."""
    # written with collapsed text, so that the patterns read a column and not its whole derivation
    m = materialize(matches.withColumn("_flat", collapse_ws(F.col("text"))), "answer-candidates")
    m = m.withColumn("_direct", direct_answer(F.col("query"), F.col("_flat"), collapsed=True))
    cand = m.where((F.col("rank") == 1) | ((F.col("rank") <= 4) & F.col("_direct").isNotNull()))
    pick_rank = F.coalesce(F.min(F.when(F.col("_direct").isNotNull(), F.col("rank"))), F.lit(1))
    best = cand.groupBy("query_id").agg(pick_rank.alias("_pick"))
    chosen = (cand.join(best, "query_id").where(F.col("rank") == F.col("_pick")))
    return chosen.select(
        "query_id", "query", F.col("rank").alias("answer_rank"),
        F.coalesce(F.col("_direct"), fallback_answer(F.col("text"))).alias("answer"),
        F.concat(F.lit("Source: "), F.col("file_name"), F.lit(" | "), F.col("location")).alias("source_line"))
