"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.functions.dna import bases, strand_neutral
from repeatloom.llm import frequent, packing, residue, runs, seen, spans, survivors, tokens
from repeatloom.shared import written
from repeatloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The upper-case trimmed letters of column {c}, and their strand-neutral form, in DuckDB.
_BASES = "upper(trim({c}, chr(32) || chr(9) || chr(13)))"
_NEUTRAL = "least({b}, reverse(translate({b}, 'atcgnATCGN', 'tagcnTAGCN')))"


def _bases(c: str) -> str:
    return _BASES.format(c=c)


def _neutral(c: str) -> str:
    return _NEUTRAL.format(b=_bases(c))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 1. Most frequent items


def _items(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "fastq_reads").select(F.lit("seq").alias("field"), bases(F.col("seq")).alias("item"), F.lit(1).cast("long").alias("weight"))
    kmers = table(spark, d, "kmers").select(F.lit("kmer").alias("field"), strand_neutral(F.col("kmer")).alias("item"), F.col("cnt").cast("long").alias("weight"))
    return reads.unionByName(kmers)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent(_items(spark, d), {"seq": (4, 1000), "kmer": (5, 1000)}, min_rows=10).select("field", "item")


SQL["p1_found"] = f"""
with r as (select {_bases("seq")} item from fastq_reads where {_bases("seq")} != ''),
k as (select {_neutral("kmer")} item, cnt::bigint w from kmers where kmer is not null and {_bases("kmer")} != '' and cnt >= 1)
select 'seq' as field, item from r group by item having count(*) >= 10 and count(*) * 1000 >= 4 * (select count(*) from r)
union all
select 'kmer', item from k group by item having count(*) >= 10 and sum(w) * 1000 >= 5 * (select sum(w) from k)
"""


@query
def p1_frequent(spark: SparkSession, d: str) -> DataFrame:
    """The summary itself: approximate counts with their greatest possible shortfall."""
    return frequent.misra_gries(_items(spark, d), 1000)


@query
def p1_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The summary held against exact counts of all values: how many true counts lie outside its bounds, and how many frequent values it lacks."""
    items = _items(spark, d).where("item is not null and item != '' and weight >= 1")
    exact = items.groupBy("field", "item").agg(F.sum("weight").alias("weight"))
    told = frequent.misra_gries(items, 1000)
    total = exact.groupBy("field").agg((F.sum("weight") / 1001).alias("most"))  # one row a field
    both = exact.join(told, ["field", "item"], "full").join(F.broadcast(total), "field")
    wrong = F.col("approx_count").isNotNull() & ~F.coalesce(F.col("weight").between(F.col("approx_count"), F.col("approx_count") + F.col("max_error")), F.lit(False))
    missing = F.col("approx_count").isNull() & (F.col("weight") > F.col("most"))
    return both.groupBy("field").agg(F.sum(wrong.cast("long")).alias("n_wrong"), F.sum(missing.cast("long")).alias("n_missing"))


SQL["p1_bounds"] = "select field, 0::bigint as n_wrong, 0::bigint as n_missing from (values ('seq'), ('kmer')) t(field)"


# 2. Long exact spans shared between records


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fastq_reads").select(F.col("read_id").alias("rec_id"), bases(F.col("seq")).alias("text"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_records(spark, d)).withColumnRenamed("rec_id", "read_id")


SQL["p2_found"] = f"""
with r as (select read_id, {_bases("seq")} s from fastq_reads where length({_bases("seq")}) >= 48),
w as (select read_id, i, s[i + 1 : i + 48] w from (select read_id, s, unnest(range(length(s) - 47)) i from r)),
v as (select * from w where not regexp_matches(w, '[^ACGT]')),
g as (select w from v group by w having count(distinct read_id) > 1),
h as (select read_id, i, lag(i) over (partition by read_id order by i) p from v where w in (select w from g)),
c as (select read_id, i, sum(case when i <= p + 48 then 0 else 1 end) over (partition by read_id order by i) k from h)
select read_id, min(i)::int as span_start, (max(i) + 48)::int as span_end from c group by read_id, k
"""


@query
def p2_extent(spark: SparkSession, d: str) -> DataFrame:
    """How much of each read is shared elsewhere."""
    return spans.shared_extent(_records(spark, d)).withColumnRenamed("rec_id", "read_id")


SQL["p2_extent"] = f"""with f as ({SQL["p2_found"]}), g as (select read_id, count(*) n, sum(span_end - span_start) c from f group by read_id)
select read_id, coalesce(n, 0)::bigint as n_spans, coalesce(c, 0)::bigint as n_shared, case when length({_bases("seq")}) > 0 then coalesce(c, 0) / length({_bases("seq")}) else 0 end::double as share
from fastq_reads left join g using (read_id)"""


# 3. Has this key been seen before?


def _answers(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("read", "kmer")) -> DataFrame:
    ledger = seen.KeyLedger(spark).load(table(spark, d, "known_keys").select("kind", F.col("seq").alias("key")))
    out = []
    if "read" in kinds:
        reads = table(spark, d, "fastq_reads")
        out.append(ledger.process(reads.select(F.lit("read").alias("kind"), strand_neutral(F.col("seq")).alias("key"), F.col("read_id").alias("row_id"), F.struct("file_idx", "ord").alias("arrival"))))
    if "kmer" in kinds:
        kmers = table(spark, d, "kmers")
        out.append(ledger.process(kmers.select(F.lit("kmer").alias("kind"), strand_neutral(F.col("kmer")).alias("key"), F.col("sighting_id").alias("row_id"), F.col("sighting_id").alias("arrival"))))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where("seen").select(F.col("kind").alias("src"), "row_id")


SQL["p3_found"] = f"""
with r as (select 'read' src, read_id row_id, {_neutral("seq")} k, row_number() over (partition by {_neutral("seq")} order by file_idx, ord) rn from fastq_reads where {_bases("seq")} != ''
union all select 'kmer', sighting_id, {_neutral("kmer")}, row_number() over (partition by {_neutral("kmer")} order by sighting_id) from kmers where {_bases("kmer")} != '')
select src, row_id from r where rn > 1 or exists (select 1 from known_keys h where h.kind = r.src and h.seq = r.k)
"""


@query
def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of wrong answers of kmers.flag, held against the ledger, and of the ledger, held
    against a recount of its keys: of a key's rows all but one are repeats, or all if it is old."""
    answers = _answers(spark, d)
    flags = table(spark, d, "kmers").select(F.lit("kmer").alias("kind"), F.col("sighting_id").alias("row_id"), (F.col("flag") == 1).alias("answered"))
    by_flag = flags.join(answers, ["kind", "row_id"]).select(F.col("kind").alias("src"), F.lit("flag").alias("answer_of"), "answered", F.col("seen").alias("truth"))
    rows = _items(spark, d).select(F.when(F.col("field") == "seq", "read").otherwise("kmer").alias("src"), F.col("item").alias("key"))
    neutral = F.when(F.col("src") == "read", strand_neutral(F.col("key"))).otherwise(F.col("key"))
    old = table(spark, d, "known_keys").select(F.col("kind").alias("src"), F.col("seq").alias("key"), F.lit(1).alias("old")).distinct()
    expected = (
        rows.withColumn("key", neutral).where("key != ''").groupBy("src", "key").agg(F.count(F.lit(1)).alias("n")).join(old, ["src", "key"], "left")
        .groupBy("src").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - F.when(F.col("old") == 1, 0).otherwise(1)).alias("repeats"))
    )
    told = answers.groupBy(F.col("kind").alias("src")).agg(F.sum(F.col("seen").cast("long")).alias("told"))
    own = expected.join(told, "src").select("src", F.lit("ledger").alias("answer_of"), "n_rows", F.abs(F.col("told") - F.col("repeats")).alias("n_wrong"))
    return seen.wrong_rates(by_flag).unionByName(own.withColumn("wrong_rate", F.col("n_wrong") / F.col("n_rows")))


SQL["p3_rates"] = f"""
with r as (select 'read' src, null::int flag, {_neutral("seq")} k, row_number() over (partition by {_neutral("seq")} order by file_idx, ord) rn from fastq_reads where {_bases("seq")} != ''
union all select 'kmer', flag, {_neutral("kmer")}, row_number() over (partition by {_neutral("kmer")} order by sighting_id) from kmers where {_bases("kmer")} != ''),
t as (select src, flag, rn > 1 or exists (select 1 from known_keys h where h.kind = r.src and h.seq = r.k) truth from r)
select src, 'flag' as answer_of, count(*) as n_rows, count(*) filter ((flag = 1) != truth) as n_wrong, count(*) filter ((flag = 1) != truth) / count(*) as wrong_rate from t where flag is not null group by src
union all select src, 'ledger', count(*), 0, 0.0 from t group by src
"""


# 4. Repeated consecutive events in sequences


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fastq_reads").select(F.col("file_idx").alias("entity"), "ord", "name", bases(F.col("seq")).alias("text"), F.col("sequenced_at").alias("at"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(_events(spark, d), min_run=2).select(F.col("entity").cast("int").alias("file_idx"), "first_ord", "last_ord")


_P4 = f"""
with r as (select file_idx, ord, name, sequenced_at, {_bases("seq")} s from fastq_reads),
l as (select *, lag(s) over w p from r window w as (partition by file_idx order by ord)),
j as (select *, case when s != '' and length(s) = length(p) and hamming(s, p) <= 2 then 0 else 1 end n from l),
c as (select *, sum(n) over (partition by file_idx order by ord) k from j)
"""
SQL["p4_found"] = _P4 + "select file_idx, min(ord) as first_ord, max(ord) as last_ord from c group by file_idx, k having count(*) > 1"


@query
def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run as one read, with its number of reads and its time."""
    return runs.collapse_runs(_events(spark, d)).select(F.col("entity").cast("int").alias("file_idx"), "first_ord", "last_ord", "name", "n_events", "seconds")


SQL["p4_runs"] = _P4 + """select file_idx, min(ord) as first_ord, max(ord) as last_ord, any_value(name) filter (n = 1) as name, count(*) as n_events,
(epoch_us(max(sequenced_at)) - epoch_us(min(sequenced_at))) / 1e6 as seconds from c group by file_idx, k"""


# 5. Best representative of each duplicate group


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # By its definition (and SQL) a letter that disagrees with the votes counts as much as one that agrees: places left unfilled are the distance.
    found = survivors.survivors(table(spark, d, "fastq_reads"), min_rows=2, disagreement=0.0)
    return found.select(
        F.col("first_id").alias("first_read_id"), F.coalesce("seq_id", F.lit(-1)).alias("seq_read_id"), F.coalesce("qual_id", F.lit(-1)).alias("qual_read_id")
    )


SQL["p5_found"] = f"""
with a as (select *, {_bases("seq")} s, regexp_replace(lower(trim(name, chr(32) || chr(9) || chr(13))), '^@', '') nm from fastq_reads where name is not null),
b as (select *, split_part(nm, ' ', 1) h from a),
c as (select *, case when regexp_matches(h, '/[12]$') then h[:-3] else h end t, case when regexp_matches(h, '/[12]$') then right(h, 1) else substr(nm, length(h) + 2, 1) end m,
  length(regexp_replace(s, '[^ACGT]', '', 'g')) n,
  case when s != '' and length(s) = length(qual) then list_sum(list_transform(string_split(qual, ''), lambda x: ord(x))) - length(qual) * qual_offset end v from b),
g as (select *, min(read_id) over w f, count(*) over w k,
  row_number() over (partition by t, m order by coalesce(n, 0) desc, loaded_at desc nulls last, read_id) rs,
  row_number() over (partition by t, m order by v desc nulls last, loaded_at desc nulls last, read_id) rq from c window w as (partition by t, m))
select any_value(f) as first_read_id, coalesce(max(read_id) filter (rs = 1 and n > 0), -1) as seq_read_id, coalesce(max(read_id) filter (rq = 1 and v is not null), -1) as qual_read_id
from g where k > 1 group by t, m
"""


@query
def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per template and mate: the bases closest to the voted consensus, places left unfilled and places that disagree
    counted alike, the best qualities, and the consensus."""
    best = survivors.survivors(table(spark, d, "fastq_reads"), disagreement=1.0)
    return best.select("template", "mate", "n", "first_id", "seq_id", "seq", "qual_id", "qual", "consensus")


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of p5_survivors with what does not depend on the consensus."""
    best = survivors.survivors(table(spark, d, "fastq_reads"), disagreement=1.0)
    return best.select("template", "mate", "n", "first_id", "qual_id", F.col("seq_id").isNotNull().alias("has_bases"))


SQL["p5_groups"] = SQL["p5_found"].partition("select any_value(f)")[0] + """select t as template, m as mate, count(*) as n, any_value(f) as first_id,
max(read_id) filter (rq = 1 and v is not null) as qual_id, coalesce(max(n), 0) > 0 as has_bases from g group by t, m"""


# 7. Encoding of the whole corpus


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


@query
def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text comes back from its ids; a null text comes back empty."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(documents)).withColumnRenamed("text", "decoded")
    return documents.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


SQL["p7_roundtrip"] = "select doc_id, true as same from documents"


# 8. Filling fixed-capacity containers


@query
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every post (of every piece of those larger than the capacity), for each kind of container."""
    sizes = tokens.count(table(spark, d, "documents")).select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size"))
    return packing.pack_kinds(sizes, table(spark, d, "containers")).withColumnsRenamed({"item_id": "doc_id", "length": "n_tokens"})


@query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well each kind of container is used: containers, tokens, least possible number, share of unused space."""
    placed = p8_packed(spark, d)
    used = placed.groupBy("container_id", "capacity").agg(F.countDistinct("container_no").alias("n_containers"), F.sum("n_tokens").alias("tokens"))
    return used.withColumns({"least": F.ceil(F.col("tokens") / F.col("capacity")), "unused": 1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity"))})


@query
def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing of each kind keeps its rules: every post once and whole, in pieces only above the capacity; fills that are the sums of
    their pieces and within the capacity; at most one in a hundred containers, and one, more than the tokens need."""
    sizes = written(tokens.count(table(spark, d, "documents")), "tokens")
    placed = written(packing.pack_kinds(sizes.select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size")), table(spark, d, "containers")), "placed")
    key = ["container_id", "capacity"]
    posts = placed.groupBy(*key, "item_id").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("pieces")).join(sizes.withColumnRenamed("doc_id", "item_id"), "item_id")
    needed = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity")))
    whole = posts.groupBy(*key).agg(F.count(F.lit(1)).alias("n_docs"), F.min((F.col("tokens") == F.col("n_tokens")) & (F.col("n") == needed) & (F.col("pieces") == needed)).alias("whole"))
    boxes = placed.groupBy(*key, "container_no").agg(F.sum("length").alias("tokens"), F.min("fill").alias("a"), F.max("fill").alias("b"))
    full = boxes.groupBy(*key).agg(
        F.min((F.col("tokens") == F.col("a")) & (F.col("tokens") == F.col("b")) & (F.col("tokens") <= F.col("capacity"))).alias("within"),
        (F.count(F.lit(1)) <= F.ceil(F.sum("tokens") / F.first("capacity")) * 1.01 + 1).alias("few"),
    )
    return whole.join(full, key)


SQL["p8_valid"] = """select container_id, capacity, (select count(*) from documents) as n_docs, true as whole, true as within, true as few from containers"""


# 9. Template residue and error-page text


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


@query
def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The rest of the corpus."""
    documents = table(spark, d, "documents")
    return documents.join(residue.residue(documents).select("doc_id"), "doc_id", "left_anti").select("doc_id", "text")


@query
def p9_parts(spark: SparkSession, d: str) -> DataFrame:
    """Whether found posts and the clean corpus together are all posts, each once."""
    documents = table(spark, d, "documents")
    found = written(residue.residue(documents).select("doc_id"), "found")
    clean = documents.join(found, "doc_id", "left_anti").select("doc_id")
    both = found.unionByName(clean).agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("doc_id").alias("n"))
    return both.select("n_docs", (F.col("n_docs") == F.col("n")).alias("each_once"))


SQL["p9_parts"] = "select count(*) as n_docs, true as each_once from documents"
