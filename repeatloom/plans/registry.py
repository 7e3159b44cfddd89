"""All registered queries of the core and their SQL, over fastq_reads, kmers, blocks, checks, trf and raw_records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.functions.dna import bases, phred_shift, revcomp, revcomp_iupac
from repeatloom.operators import checklist, derive, extend, kmers, merge, records, select, trf
from repeatloom.shared import fresh_path, spread, written
from repeatloom.sources import fastq
from repeatloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Parameters of the registered queries.
COPIES, FLANK, K = 3, 29, 27


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads that a strict FASTQ reader admits: letters A, C, G, T, N and points, in upper case. Such a reader fails on the
    others; here they are left out of the read queries and given by fastq_rejected (93 of 6,000 rows at sf0.01)."""
    r = table(spark, d, "fastq_reads").select("read_id", "file_idx", "ord", "name", bases(F.col("seq")).alias("seq"), "qual", "qual_offset")
    return r.where(F.col("seq").rlike("^[ACGTN.]+$"))


_READS = "with rd as (select read_id, file_idx, ord, name, upper(trim(seq, chr(32) || chr(9) || chr(13))) s, qual, qual_offset from fastq_reads where regexp_matches(upper(trim(seq, chr(32) || chr(9) || chr(13))), '^[ACGTN.]+$'))"
_RC = "reverse(translate({0}, 'atcgnATCGN', 'tagcnTAGCN'))"


def _rc(c: str) -> str:
    return _RC.format(c)


def _candidate_ctes(text: str, name: str, copies: int = COPIES, lengths: tuple[int, ...] = select.MOTIF_LENGTHS) -> str:
    """Gaps and islands: runs of places that equal the place k further on."""
    ks = ", ".join(map(str, lengths))
    return f"""
{name}_i as (select read_id, s, length(s) n, k, unnest(range(length(s))) i from (select read_id, {text} s, unnest([{ks}]) k from rd)),
{name}_e as (select *, case when i + k < n and s[i + 1] = s[i + k + 1] then null else i end z from {name}_i),
{name}_f as (select *, min(z) over (partition by read_id, k order by i rows between current row and unbounded following) nf from {name}_e),
{name}_c as (select read_id, n, k, i as start, (nf - i) // k + 1 as copies, i + ((nf - i) // k + 1) * k as "end", ((nf - i) // k + 1) * k as len, s[i + 1 : i + k] as motif,
  s[i + 1 : i + ((nf - i) // k + 1) * k] as str from {name}_f where (nf - i) // k + 1 >= {copies} and i + k <= n and not contains(s[i + 1 : i + k], 'N'))"""


def _best_cte(name: str, where: str = "true") -> str:
    return f"""
{name}_r as (select *, row_number() over (partition by read_id order by len desc, copies desc, str desc, motif desc, start desc, "end" desc) rn from {name}_c where {where}),
{name} as (select * from {name}_r where rn = 1)"""


_FLANKED = f'start >= {FLANK} and n - "end" >= {FLANK}'
_MATCH_COLUMNS = ("len", "copies", "str", "motif", "start", "end")


def _flat(df: DataFrame, *matches: str) -> DataFrame:
    """Matches as plain columns, those of the other strand with rc_ before."""
    cols = [F.col(f"{m}.{c}").alias(c if m == "fwd" else f"rc_{c}") for m in matches for c in _MATCH_COLUMNS]
    return df.select("read_id", *cols)


def _both_sql(where: str = _FLANKED, after: str = "", lengths: tuple[int, ...] = select.MOTIF_LENGTHS) -> str:
    a = ", ".join(f'a.{c}::int as {c}' if c in ("len", "copies", "start") else f'a."{c}"::int as "{c}"' if c == "end" else f"a.{c} as {c}" for c in _MATCH_COLUMNS)
    b = ", ".join(f'b."{c}"::int as rc_{c}' if c in ("len", "copies", "start", "end") else f"b.{c} as rc_{c}" for c in _MATCH_COLUMNS)
    return f"""{_READS},{_candidate_ctes("s", "a", lengths=lengths)},{_candidate_ctes(_rc("s"), "b", lengths=lengths)},{_best_cte("a", where)},{_best_cte("b", where)}
select a.read_id, {a}, {b} from a join b using (read_id) {after}"""


# Reads and their text forms


@query
def derived_reads(spark: SparkSession, d: str) -> DataFrame:
    return derive.reads_of_texts(table(spark, d, "documents"))


SQL["derived_reads"] = """with z as (select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') z from documents where text is not null)
select doc_id, i // 50 as ord, z[i + 1 : i + 100] as seq from (select doc_id, z, unnest(range(0, length(z) - 99, 50)) i from z)"""


@query
def derived_str_best(spark: SparkSession, d: str) -> DataFrame:
    """Best forward repeat of each read that is derived from a post."""
    found = select.with_best_matches(derive.reads_of_texts(table(spark, d, "documents")), ("fwd",), COPIES, FLANK)
    return found.select("doc_id", "ord", F.col("fwd.motif").alias("motif"), F.col("fwd.copies").alias("copies"), F.col("fwd.start").alias("start"))


@query
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("file_idx", "ord", "name", "seq", "qual")


SQL["fastq_records"] = _READS + " select file_idx, ord, name, s as seq, qual from rd"


@query
def fastq_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the read queries leave out, with the reason: no bases, or other letters than the strict alphabet."""
    r = table(spark, d, "fastq_reads").select("read_id", bases(F.col("seq")).alias("s"))
    reason = F.when(F.col("s").isNull(), "null").when(F.col("s") == "", "empty").when(F.col("s").rlike("[^ACGTN.]"), "letters")
    return r.select("read_id", reason.alias("reason")).where("reason is not null")


SQL["fastq_rejected"] = """select read_id, case when s is null then 'null' when s = '' then 'empty' else 'letters' end as reason
from (select read_id, upper(trim(seq, chr(32) || chr(9) || chr(13))) s from fastq_reads) where s is null or s = '' or regexp_matches(s, '[^ACGTN.]')"""


_DERIVED = SQL["derived_reads"]
SQL["derived_str_best"] = f"""with d as ({_DERIVED}), rd as (select row_number() over () read_id, doc_id, ord, seq s from d),{_candidate_ctes("s", "a")},{_best_cte("a", _FLANKED)}
select doc_id, ord, motif, copies::int as copies, start::int as start from a join rd using (read_id)"""


@query
def revcomp_reads(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", revcomp(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual"))


SQL["revcomp_reads"] = f"{_READS} select read_id, {_rc('s')} as seq, reverse(qual) as qual from rd"


@query
def phred_shift_reads(spark: SparkSession, d: str) -> DataFrame:
    """Qualities of the Phred+64 libraries as Phred+33."""
    q = F.when(F.col("qual_offset") == 64, phred_shift(F.col("qual"))).otherwise(F.col("qual"))
    return reads(spark, d).select("read_id", q.alias("qual"))


_HIGH, _LOW = "".join(map(chr, range(64, 127))), "".join(map(chr, range(33, 96))).replace("'", "''")
SQL["phred_shift_reads"] = f"{_READS} select read_id, case when qual_offset = 64 then translate(qual, '{_HIGH}', '{_LOW}') else qual end as qual from rd"


@query
def revcomp_ambiguity_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reverse complements over the whole ambiguity alphabet, of all rows."""
    return table(spark, d, "fastq_reads").select("read_id", revcomp_iupac(bases(F.col("seq"))).alias("seq"))


_IUPAC = "reverse(regexp_replace(translate({0}, 'ABCDGHKMNRSTVWXYabcdghkmnrstvwxy', 'TVGHCDMKNYSABWXRtvghcdmknysabwxr'), '[^ABCDGHKMNRSTVWXYabcdghkmnrstvwxy]', ' ', 'g'))"
SQL["revcomp_ambiguity_reads"] = f"select read_id, {_IUPAC.format('upper(trim(seq, chr(32) || chr(9) || chr(13)))')} as seq from fastq_reads"


@query
def quality_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Reads as FASTA, and their qualities as numbers under the same header."""
    r = reads(spark, d).where("name is not null and qual is not null")
    return r.select("read_id", fastq.fasta_text(F.col("name"), F.col("seq")).alias("fasta"), fastq.quality_text(F.col("name"), F.col("qual")).alias("numbers"))


SQL["quality_numbers"] = f"""{_READS} select read_id, '>' || name || chr(10) || s as fasta,
'>' || name || chr(10) || case when qual = '' then '' else array_to_string(list_transform(string_split(qual, ''), lambda x: ord(x) - 33), ' ') end as numbers from rd where name is not null and qual is not null"""


# Files


def _as_fastq(rows: DataFrame, name: str) -> str:
    """Rows written as FASTQ text in their order; the folder."""
    path = fresh_path(rows.sparkSession, name)
    text = fastq.fastq_text(F.coalesce("name", F.lit("")), F.col("seq"), F.coalesce("qual", F.lit("")))
    fastq.write_ordered(rows.select("file_idx", "ord", text.alias("value")), path, "file_idx", "ord")
    return path


@query
def fastq_text_scan(spark: SparkSession, d: str) -> DataFrame:
    """All reads written as two sets of FASTQ files, those of even and those of odd file numbers, and read again."""
    r = reads(spark, d)
    return fastq.read_fastq(spark, [_as_fastq(r.where(F.pmod("file_idx", F.lit(2)) == part), f"fastq-{part}") for part in (0, 1)])


SQL["fastq_text_scan"] = f"""{_READS} select file_idx % 2 as file_idx, row_number() over (partition by file_idx % 2 order by file_idx, ord) - 1 as ord,
coalesce(name, '') as name, s as seq, coalesce(qual, '') as qual from rd"""


@query
def fastq_text_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """All reads written as FASTQ by quality code, read with the codes shifted and 3' bases of low quality trimmed."""
    r = reads(spark, d)
    high = fastq.read_fastq(spark, _as_fastq(r.where("qual_offset = 64"), "fastq-64"), strict=False, trim=True, illumina=True)
    low = fastq.read_fastq(spark, _as_fastq(r.where("qual_offset != 64"), "fastq-33"), strict=False, trim=True)
    return high.unionByName(low).select("name", "seq", "qual")


SQL["fastq_text_trimmed"] = f"""{_READS}, q as (select coalesce(name, '') as name, s, regexp_replace(case when qual_offset = 64 then translate(coalesce(qual, ''), '{_HIGH}', '{_LOW}') else coalesce(qual, '') end, '[!"#]+$', '') as qual from rd)
select name, s[1 : length(qual)] as seq, qual from q"""


@query
def blocks_text_scan(spark: SparkSession, d: str) -> DataFrame:
    """Blocks written as FASTQ with the five-field header and parsed again."""
    b = table(spark, d, "blocks").where("motif is not null and copies is not null and start is not null and `end` is not null and seq is not null").withColumn("qual", F.coalesce("qual", F.lit("")))
    path = fresh_path(spark, "blocks")
    fastq.write_ordered(fastq.block_text(b), path, "block_id")
    return fastq.parse_blocks(fastq.read_fastq(spark, path)).select("block_id", "motif", F.array_join(F.col("copies").cast("array<string>"), ",").alias("copies"), "start", "end", "seq", "qual")


SQL["blocks_text_scan"] = """select block_id, motif, array_to_string(copies, ',') as copies, start, "end", upper(seq) as seq, coalesce(qual, '') as qual from blocks
where motif is not null and copies is not null and start is not null and "end" is not null and seq is not null"""


@query
def checks_text_scan(spark: SparkSession, d: str) -> DataFrame:
    """The check-list written as text, with None for an empty flank, and read again."""
    flank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "None").otherwise(F.col(c))
    c = table(spark, d, "checks").where("motif is not null and copies is not null")
    path = fresh_path(spark, "checks")
    c.select(F.concat_ws(" ", "motif", "copies", flank("lflank"), flank("rflank")).alias("value")).write.text(path)
    return fastq.read_checks(spark, path).drop("check_id")


SQL["checks_text_scan"] = "select motif, copies, coalesce(lflank, '') as lflank, coalesce(rflank, '') as rflank from checks where motif is not null and copies is not null"


@query
def trf_text_scan(spark: SparkSession, d: str) -> DataFrame:
    """The report written as text, every row under a header, and read again."""
    t = table(spark, d, "trf").where("name is not null and size(tokens) > 0")
    path = fresh_path(spark, "report")
    lines = t.select("line_ord", F.array(F.concat(F.lit("@"), F.col("name")), F.array_join(F.transform("tokens", lambda x: F.coalesce(x, F.lit("-"))), " ")).alias("v")).select("line_ord", F.posexplode("v").alias("k", "value"))
    fastq.write_ordered(lines, path, "line_ord", "k")
    return fastq.read_report(spark, path).select("name", F.array_join("tokens", "\t").alias("line"))


SQL["trf_text_scan"] = "select trim(name) as name, array_to_string(list_transform(tokens, lambda x: coalesce(x, '-')), chr(9)) as line from trf where name is not null and len(tokens) > 0"


# Select


@query
def str_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = select.candidates(F.col("seq"), COPIES)
    return spread(reads(spark, d)).where(F.col("seq").rlike("(..)\\1\\1|(...)\\2\\2|(....)\\3\\3|(.....)\\4\\4|(......)\\5\\5")).select("read_id", F.inline(found))


SQL["str_candidates"] = f"""{_READS},{_candidate_ctes("s", "a")}
select read_id, len::int as len, copies::int as copies, str, motif, start::int as start, "end"::int as "end" from a_c"""


@query
def str_best_forward(spark: SparkSession, d: str) -> DataFrame:
    return _flat(select.with_best_matches(reads(spark, d), ("fwd",), COPIES, FLANK), "fwd")


SQL["str_best_forward"] = f"""{_READS},{_candidate_ctes("s", "a")},{_best_cte("a", _FLANKED)}
select read_id, len::int as len, copies::int as copies, str, motif, start::int as start, "end"::int as "end" from a"""


@query
def str_best_reverse(spark: SparkSession, d: str) -> DataFrame:
    return _flat(select.with_best_matches(reads(spark, d), ("rc",), COPIES, FLANK), "rc")


SQL["str_best_reverse"] = f"""{_READS},{_candidate_ctes(_rc("s"), "a")},{_best_cte("a", _FLANKED)}
select read_id, len::int as rc_len, copies::int as rc_copies, str as rc_str, motif as rc_motif, start::int as rc_start, "end"::int as rc_end from a"""


def selected(spark: SparkSession, d: str, **options) -> DataFrame:
    return select.select_str_reads(reads(spark, d), COPIES, FLANK, **options)


@query
def str_selected_reads(spark: SparkSession, d: str) -> DataFrame:
    return _flat(selected(spark, d), "fwd", "rc")


SQL["str_selected_reads"] = _both_sql()


@query
def str_selected_rank_first(spark: SparkSession, d: str) -> DataFrame:
    return _flat(selected(spark, d, rank_before_filter=True), "fwd", "rc")


SQL["str_selected_rank_first"] = _both_sql("true", f'where a.start >= {FLANK} and a.n - a."end" >= {FLANK} and b.start >= {FLANK} and b.n - b."end" >= {FLANK}')


@query
def str_no_homopolymer(spark: SparkSession, d: str) -> DataFrame:
    return _flat(selected(spark, d, remove_homopolymers=True), "fwd", "rc")


SQL["str_no_homopolymer"] = _both_sql(_FLANKED + " and motif != repeat(motif[1], k)")


@query
def str_motif_subset(spark: SparkSession, d: str) -> DataFrame:
    return _flat(selected(spark, d, motif_lengths=(3, 5)), "fwd", "rc")


SQL["str_motif_subset"] = _both_sql(lengths=(3, 5))


@query
def motif_histogram(spark: SparkSession, d: str) -> DataFrame:
    return selected(spark, d).groupBy(F.col("fwd.motif").alias("motif"), F.col("fwd.copies").alias("copies")).agg(F.count(F.lit(1)).alias("n_reads"))


SQL["motif_histogram"] = f"select motif, copies, count(*) as n_reads from ({_both_sql()}) group by motif, copies"


@query
def str_annotated_names(spark: SparkSession, d: str) -> DataFrame:
    """The nine header fields of each selected read, as the text sink writes them."""
    return selected(spark, d).select("read_id", select.annotated_name(F.col("name"), F.col("fwd"), F.col("rc")).alias("header"))


SQL["str_annotated_names"] = f"""select read_id, concat_ws(chr(9), name, motif, copies, start, "end", rc_motif, rc_copies, rc_start, rc_end) as header from ({_both_sql()}) join fastq_reads using (read_id)"""


@query
def str_checklist_hits(spark: SparkSession, d: str) -> DataFrame:
    checks = checklist.with_check_ids(table(spark, d, "checks"))
    return checklist.checklist_hits(selected(spark, d), checks)


@query
def str_checklist_misses(spark: SparkSession, d: str) -> DataFrame:
    """Selected reads that no entry accepts, with their best identity."""
    return checklist.checklist_misses(selected(spark, d), checklist.with_check_ids(table(spark, d, "checks")))


_SAME = "len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: upper({0})[i] = upper({1})[i]))"
_HITS = f"""with sel as ({_both_sql()}),
x as (select read_id, file_idx, ord, upper(trim(seq, chr(32) || chr(9) || chr(13))) s, {_rc("upper(trim(seq, chr(32) || chr(9) || chr(13)))")} r, sel.* exclude (read_id) from sel join fastq_reads using (read_id)),
y as (select *, s[greatest(0, start - 20) + 1 : start] fl, s["end" + 1 : "end" + 20] fr, r[greatest(0, rc_start - 20) + 1 : rc_start] rl, r[rc_end + 1 : rc_end + 20] rr from x),
p as (select file_idx, ord, 0 probe, motif, copies, fl l, fr r from y union all select file_idx, ord, 1, {_rc("motif")}, copies, {_rc("fr")}, {_rc("fl")} from y
union all select file_idx, ord, 2, rc_motif, rc_copies, rl, rr from y union all select file_idx, ord, 3, {_rc("rc_motif")}, rc_copies, {_rc("rr")}, {_rc("rl")} from y),
c as (select *, concat_ws(':', motif, copies, row_number() over (partition by motif, copies order by lflank nulls first, rflank nulls first)) check_id from checks),
g as (select file_idx, ord, probe, check_id, coalesce(({_SAME.format("reverse(cl)", "reverse(l)")} + {_SAME.format("cr", "r")}) * 100.0 / nullif(least(length(cl), length(l)) + least(length(cr), length(r)), 0), 0) pid
from p join (select check_id, motif, copies, coalesce(lflank, '') cl, coalesce(rflank, '') cr from c) using (motif, copies)),
f as (select check_id, row_number() over (partition by file_idx, ord order by probe, check_id) rn from g where pid > 90)"""
SQL["str_checklist_hits"] = _HITS + " select check_id, motif, copies, (select count(*) from f where f.check_id = c.check_id and rn = 1) as found from c"
SQL["str_checklist_misses"] = _HITS + """ select file_idx, ord, coalesce(max(pid), 0)::double as best from (select distinct file_idx, ord from p) left join g using (file_idx, ord)
group by file_idx, ord having coalesce(max(pid), 0) <= 90"""


# Merge


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_keys(selected(spark, d), K)


_KEYED = f"""with sel as ({_both_sql()}),
x as (select file_idx, ord, upper(trim(seq, chr(32) || chr(9) || chr(13))) s, {_rc("upper(trim(seq, chr(32) || chr(9) || chr(13)))")} r, sel.* from sel join fastq_reads using (read_id)),
y as (select read_id, file_idx, ord, copies, rc_copies, concat_ws(' ', motif, s[start - {K} + 1 : start], s["end" + 1 : "end" + {K}]) fwd_key, concat_ws(' ', rc_motif, r[rc_start - {K} + 1 : rc_start], r[rc_end + 1 : rc_end + {K}]) rc_key from x),
l as (select least(fwd_key, rc_key) locus, case when fwd_key <= rc_key then copies else rc_copies end copies, count(*) nsupport, min((file_idx, ord)) first_seen from y group by 1, 2)"""


@query
def merge_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).select("read_id", "fwd_key", "rc_key")


SQL["merge_keys"] = _KEYED + " select read_id, fwd_key, rc_key from y"


@query
def locus_support(spark: SparkSession, d: str) -> DataFrame:
    return merge.loci(_keyed(spark, d), min_support=2).select("locus", "support")


SQL["locus_support"] = _KEYED + " select locus, sum(nsupport)::bigint as support from l group by locus having sum(nsupport) between 2 and 10000"


@query
def locus_alleles(spark: SparkSession, d: str) -> DataFrame:
    return merge.loci(_keyed(spark, d), min_support=2).select("locus", F.posexplode("alleles").alias("place", "a")).select("locus", "place", "a.copies", "a.nsupport")


SQL["locus_alleles"] = _KEYED + """, s as (select locus from l group by locus having sum(nsupport) between 2 and 10000),
a as (select *, row_number() over (partition by locus order by first_seen desc) - 1 p from l where nsupport >= 2 and locus in (select locus from s))
select locus, p::int as place, copies, nsupport from a where p < 3"""


@query
def polymorphic_loci(spark: SparkSession, d: str) -> DataFrame:
    return merge.loci(_keyed(spark, d)).where(F.size("alleles") == 2).select("locus", "support", F.col("alleles")[0]["copies"].alias("copies_1"), F.col("alleles")[1]["copies"].alias("copies_2"))


SQL["polymorphic_loci"] = _KEYED + """, a as (select *, row_number() over (partition by locus order by first_seen desc) p, count(*) over (partition by locus) n from l where nsupport >= 2),
s as (select locus, sum(nsupport)::bigint support from l group by locus having sum(nsupport) between 4 and 10000)
select locus, any_value(support) as support, max(copies) filter (p = 1) as copies_1, max(copies) filter (p = 2) as copies_2 from a join s using (locus) where n = 2 group by locus"""


@query
def merged_blocks(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_str_reads(selected(spark, d), K, min_support=2, include_all=True)


def _agreeing(keyed: DataFrame) -> DataFrame:
    """block_id of the loci whose two keys lead nowhere else and whose reads' flanks are all parts of the longest ones."""
    keyed = written(keyed, "keyed")
    edges = keyed.select(F.col("fwd_key").alias("a"), F.col("rc_key").alias("b")).unionByName(keyed.select(F.col("rc_key").alias("a"), F.col("fwd_key").alias("b")))
    lone = edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo = hi and lo != a")
    closed = lone.alias("x").join(lone.alias("y"), (F.col("x.lo") == F.col("y.a")) & (F.col("y.lo") == F.col("x.a"))).where("x.a < y.a").select(F.col("x.a").alias("locus"))
    at = F.struct("file_idx", "ord")
    own = keyed.withColumn("locus", F.least("fwd_key", "rc_key")).join(closed, "locus")
    founder = own.groupBy("locus").agg(F.min_by("rc_key", at).alias("block_key"), F.min(at).alias("at"))
    back = F.col("rc_key") == F.col("block_key")
    text = F.when(back, revcomp(F.col("seq"))).otherwise(F.col("seq"))
    place = lambda c: F.when(back, F.col(f"rc.{c}")).otherwise(F.col(f"fwd.{c}"))
    sides = own.join(founder, "locus").select("locus", "at", "seq", F.substr(text, F.lit(1), place("start")).alias("l"), F.substr(text, place("end") + 1, F.length("seq")).alias("r"))
    most = sides.groupBy("locus").agg(F.max_by("l", F.length("l")).alias("ll"), F.max_by("r", F.length("r")).alias("rr"), F.min_by("r", F.length("r")).alias("short"))
    fits = F.col("ll").endswith(F.col("l")) & F.col("rr").startswith(F.col("r")) & ~F.contains(F.expr("substr(rr, 2)"), F.col("short")) & ~F.col("seq").contains(".")
    good = sides.join(most, "locus").groupBy("locus", "at").agg(F.min(fits).alias("fits")).where("fits")
    return good.select((F.shiftleft(F.col("at.file_idx").cast("long"), 40) + F.col("at.ord")).alias("block_id"))


@query
def merged_blocks_agreeing(spark: SparkSession, d: str) -> DataFrame:
    """Of merged_blocks those whose reads all agree: there the ordered fold has a result that SQL can tell."""
    picked = written(selected(spark, d), "selected")
    blocks = merge.merge_str_reads(picked, K, min_support=2, include_all=True)
    ids = _agreeing(merge.merge_keys(picked, K))
    return blocks.join(ids, "block_id", "left_semi").select("block_id", "motif", F.array_join(F.col("copies").cast("array<string>"), ",").alias("copies"), "start", "end", "seq", "support")


SQL["merged_blocks_agreeing"] = f"""with sel as ({_both_sql()}),
x as (select file_idx, ord, upper(trim(seq, chr(32) || chr(9) || chr(13))) s, sel.* from sel join fastq_reads using (read_id)),
y as (select *, {_rc("s")} r, concat_ws(' ', motif, s[start - {K} + 1 : start], s["end" + 1 : "end" + {K}]) f, concat_ws(' ', rc_motif, ({_rc("s")})[rc_start - {K} + 1 : rc_start], ({_rc("s")})[rc_end + 1 : rc_end + {K}]) g from x),
e as (select f a, g b from y union all select g, f from y),
o as (select a, min(b) b from e group by a having min(b) = max(b) and min(b) != a),
c as (select o.a locus from o join o p on p.a = o.b and p.b = o.a where o.a < p.a),
z as (select *, least(f, g) locus, first_value(g) over w key, first_value(file_idx) over w fi, first_value(ord) over w fo from y where least(f, g) in (select locus from c) window w as (partition by least(f, g) order by file_idx, ord)),
t as (select locus, fi, fo, file_idx, ord, s, case when g = key then rc_motif else motif end m, case when g = key then rc_copies else copies end n,
  case when g = key then r[:rc_start] else s[:start] end l, case when g = key then r[rc_end + 1:] else s["end" + 1:] end q from z),
u as (select locus, arg_max(l, length(l)) ll, arg_max(q, length(q)) rr, arg_min(q, length(q)) sh from t group by 1),
v as (select locus, min(fi) fi, min(fo) fo, min(m) m, any_value(ll) ll, any_value(rr) rr, count(*) support from t join u using (locus) group by locus
  having bool_and(ends_with(ll, l) and starts_with(rr, q) and not contains(rr[2:], sh) and not contains(s, '.'))),
al as (select locus, n, row_number() over (partition by locus order by min((file_idx, ord)) desc) p from t group by locus, n having count(*) >= 2),
k as (select locus, list(n order by p) cs from al where p <= 3 group by locus),
h as (select v.*, coalesce(cs, [0]) cs from v left join k using (locus) where support between 2 and 10000 and coalesce(len(cs), 0) <= 2)
select (fi::bigint << 40) + fo as block_id, m as motif, array_to_string(cs, ',') as copies, length(ll)::int as start, (length(ll) + list_max(cs) * length(m))::int as "end", ll || repeat(m, list_max(cs)) || rr as seq, support::int as support from h"""


@query
def merged_reads(spark: SparkSession, d: str) -> DataFrame:
    """Whether every selected read is in a block or among the lost ones."""
    picked = written(selected(spark, d), "selected")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    given = picked.select(one.alias("given"), zero.alias("told"))
    kept = merge.fold_blocks(picked, K).select(zero.alias("given"), F.col("support").cast("long").alias("told"))
    lost = merge.lost_reads(picked, K).select(zero.alias("given"), one.alias("told"))
    sums = given.unionByName(kept).unionByName(lost).agg(F.coalesce(F.sum("given"), zero).alias("n_reads"), F.coalesce(F.sum("told"), zero).alias("told"))
    return sums.select("n_reads", (F.col("told") == F.col("n_reads")).alias("all_told"))


SQL["merged_reads"] = f"select count(*) as n_reads, true as all_told from ({_both_sql()})"


@query
def merged_blocks_polymorphic(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_str_reads(selected(spark, d), K)


# K-mers and the graph


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return reads(spark, d), table(spark, d, "blocks").where("seq is not null and start is not null and `end` is not null")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    r, b = _texts(spark, d)
    return kmers.count_kmers(r, K, b)


_COUNTS = f"""{_READS},
tx as (select translate(s, 'N', 'A') s from rd union all select translate(upper(seq), 'N', 'A') from blocks where seq is not null and start is not null and "end" is not null),
w as (select s[i : i + {K - 1}] w from (select s, unnest(range(1, length(s) - {K} + 2)) i from tx where length(s) >= {K})),
kc as materialized (select least(w, {_rc("w")}) kmer, least(count(*), 255)::bigint cnt from w where not regexp_matches(w, '[^ACGT]') group by 1),
so as materialized (select kmer from kc where cnt >= 2)"""
# Oriented solid k-mers, and one backward step from the first k-1 letters of a k-mer.
_GRAPH = _COUNTS + f""",
nd as (select kmer node, true own from so union all select {_rc("kmer")}, false from so),
cx as materialized (select node[2:] ctx, count(*) degree, arg_max(node, case when own then (instr('ACGT', node[1]) - 1, 0) else (4 - instr('ACGT', node[1]), 1) end) chosen, min(node) b1, max(node) b2 from nd group by 1)"""


@query
def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


SQL["kmer_counts"] = _COUNTS + " select kmer, cnt from kc"


@query
def solid_kmers(spark: SparkSession, d: str) -> DataFrame:
    return kmers.solid(_counts(spark, d))


SQL["solid_kmers"] = _COUNTS + " select kmer, cnt from kc where cnt >= 2"


@query
def kmer_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return kmers.spectrum(_counts(spark, d))


SQL["kmer_spectrum"] = _COUNTS + " select cnt, count(*) as n_kmers from kc group by cnt"


@query
def kmer_degree(spark: SparkSession, d: str) -> DataFrame:
    return kmers.degrees(written(kmers.solid(_counts(spark, d)), "solid"), K)


SQL["kmer_degree"] = _GRAPH + f""" select kmer, coalesce(a.degree, 0) as n_predecessors, coalesce(b.degree, 0) as n_successors from so
left join cx a on a.ctx = kmer[:{K - 1}] left join cx b on b.ctx = ({_rc("kmer")})[:{K - 1}]"""


@query
def anchor_kmers(spark: SparkSession, d: str) -> DataFrame:
    b = _texts(spark, d)[1]
    return extend.anchors(b, written(kmers.solid(_counts(spark, d)), "solid"), K).select("block_id", "idx_left", "kmer_left", "idx_right", "kmer_right")


_ANCHORS = _GRAPH + f""",
bl as (select block_id, start zs, "end" ze, seq, translate(upper(seq), 'N', 'A') s from blocks where seq is not null and start >= {K} and length(seq) - "end" >= {K}),
lh as (select block_id, min(i) i from (select block_id, s, unnest(range(zs - {K} + 1)) i from bl) where least(s[i + 1 : i + {K}], {_rc(f"s[i + 1 : i + {K}]")}) in (select kmer from so) group by 1),
rh as (select block_id, max(i) i from (select block_id, ze, s, unnest(range(length(s) - ze - {K} + 1)) i from bl) where least(s[ze + i + 1 : ze + i + {K}], {_rc(f"s[ze + i + 1 : ze + i + {K}]")}) in (select kmer from so) group by 1),
an as (select block_id, zs, ze, seq, s, coalesce(lh.i + {K}, zs + 1)::int idx_left, (ze + coalesce(rh.i, 0))::int idx_right from bl left join lh using (block_id) left join rh using (block_id)),
ak as (select *, s[idx_left - {K} + 1 : idx_left] kmer_left, s[idx_right + 1 : idx_right + {K}] kmer_right from an where length(s) - idx_right >= {K})"""
SQL["anchor_kmers"] = _ANCHORS + " select block_id, idx_left, kmer_left, idx_right, kmer_right from ak"


def _flanks(spark: SparkSession, d: str, sides: str = "lr") -> DataFrame:
    r, b = _texts(spark, d)
    return extend.flanks(b, r, K, sides=sides)


@query
def walk_backward(spark: SparkSession, d: str) -> DataFrame:
    return _flanks(spark, d, "l").select("block_id", "lflank", "n_left")

@query
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return _flanks(spark, d, "r").select("block_id", "rflank", "n_right")


@query
def contig_identity(spark: SparkSession, d: str) -> DataFrame:
    return _flanks(spark, d).select("block_id", "pid_left", "pid_right")


@query
def contigs(spark: SparkSession, d: str) -> DataFrame:
    r, b = _texts(spark, d)
    return extend.extend_str_reads(b, r, K)


# A walk step by step; forks are taken where both branches go on without a choice and meet again.
_WALK = _ANCHORS.replace("with rd as", "with recursive rd as", 1) + f""",
br as (select ctx fork, unnest([b1, b2]) node, 0 n from cx where degree = 2),
fo as (select fork, node as first, node, 0 n from br union all select fork, first, cx.b1, fo.n + 1 from fo join cx on cx.ctx = fo.node[:{K - 1}] and cx.degree = 1 where fo.n <= {K}),
bu as (select fork from fo where n = {K} + 1 group by fork having count(*) = 2 and min(node) = max(node)),
nx as (select ctx, chosen node from cx where degree = 1 or (degree = 2 and ctx in (select fork from bu))),
st as (select block_id, 'l' side, kmer_left node from ak union all select block_id, 'r', {_rc("kmer_right")} from ak),
wk as (select block_id, side, node, [least(node, {_rc("node")})] seen, node as text from st union all
  select block_id, side, nx.node, list_append(seen, least(nx.node, {_rc("nx.node")})), nx.node[1] || text from wk join nx on nx.ctx = wk.node[:{K - 1}]
  where not list_contains(seen, least(nx.node, {_rc("nx.node")})) and len(seen) < 1024),
fl as (select block_id, side, arg_max(text, len(seen)) text, max(len(seen)) n from wk group by 1, 2),
fx as (select ak.*, l.text lflank, l.n n_left, {_rc("r.text")} rflank, r.n n_right from ak join fl l on l.block_id = ak.block_id and l.side = 'l' join fl r on r.block_id = ak.block_id and r.side = 'r'),
pd as (select *, len(list_filter(range(1, least(length(lflank), idx_left) + 1), lambda i: reverse(lflank)[i] = reverse(seq[:idx_left])[i])) * 100.0 / least(length(lflank), idx_left) pid_left,
  len(list_filter(range(1, least(length(rflank), length(seq) - idx_right) + 1), lambda i: rflank[i] = seq[idx_right + i])) * 100.0 / least(length(rflank), length(seq) - idx_right) pid_right from fx)"""
SQL["walk_backward"] = _WALK + " select block_id, lflank, n_left from fx"
SQL["walk_forward"] = _WALK + " select block_id, rflank, n_right from fx"
SQL["contig_identity"] = _WALK + " select block_id, pid_left, pid_right from pd"
SQL["contigs"] = _WALK + """ select 'Block' || block_id as name, motif, array_to_string(copies, ',') as copies, (zs + length(lflank) - idx_left)::int as start, (ze + length(lflank) - idx_left)::int as "end",
lflank || pd.seq[idx_left + 1 : idx_right] || rflank as seq from pd join (select block_id, motif, copies from blocks) using (block_id) where pid_left >= 95 and pid_right >= 95"""


# Reports


@query
def trf_top1(spark: SparkSession, d: str) -> DataFrame:
    return trf.top_repeats(table(spark, d, "trf")).select("name", "name_ord", "line_ord", F.array_join("tokens", "\t").alias("line"))


SQL["trf_top1"] = """with t as (select *, try_cast(tokens[1] as double) a, try_cast(tokens[3] as double) u, floor(try_cast(tokens[4] as double)) c, try_cast(tokens[6] as double) s from trf),
r as (select name, line_ord, tokens, row_number() over (partition by name order by s, tokens, line_ord) rn from t where a >= 100 and u between 2 and 6 and c >= (case when u = 2 then 7 else 5 end) and s is not null)
select h.name, h.name_ord, r.line_ord, array_to_string(r.tokens, chr(9)) as line from (select distinct name, name_ord from trf) h join r on r.name = h.name and rn = 1"""


# 6. Rows that fail to parse


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return records.failed(table(spark, d, "raw_records"))


_NUM = "regexp_full_match({0}, '[0-9]{{1,9}}')"
_LESS = "(case when " + _NUM + " then {0}::bigint end)"


def _match_ok(at: int, pair: bool) -> str:
    motif, copies, start, end = (f"f[{at + i}]" for i in range(4))
    counts = f"string_split({copies}, ',')" if pair else f"[{copies}]"
    size = f"len({counts}) <= {2 if pair else 1}"
    return f"""coalesce(regexp_full_match({motif}, '[ACGT]{{2,6}}') and {size} and list_bool_and(list_transform({counts}, lambda c: coalesce({_LESS.format("c")} > 0, false)))
and {_LESS.format(start)} < {_LESS.format(end)} and {_LESS.format(end)} <= length(l[2]), false)"""


_P6 = f"""with a as (select rec_id, file_idx, kind, replace(raw, chr(13), '') t from raw_records),
b as (select rec_id, file_idx, kind, string_split(case when ends_with(t, chr(10)) then t[:-2] else t end, chr(10)) l from a),
c as (select *, l[1][2:] nm, string_split(l[1], '"') q from b),
e as (select *, string_split(array_to_string(list_transform(string_split(nm, '"'), lambda p, i: case when i % 2 = 1 then replace(p, chr(9), chr(10)) else p end), '"'), chr(10)) f from c),
r as (select rec_id, file_idx, kind, f, l, case when l is null or len(l) != 4 then 'lines'
when not starts_with(l[1], '@') or trim(nm, chr(32) || chr(9)) = '' then 'header'
when not starts_with(l[3], '+') then 'separator'
when regexp_matches(l[2], '[^acgtnACGTN.]') then 'bases'
when length(l[4]) != length(l[2]) then 'qual_length'
when regexp_matches(l[4], '[^!-~]') then 'qual_chars'
when len(q) % 2 = 0 then 'quoting'
when len(f) != coalesce(case kind when 'reads' then 1 when 'str_reads' then 9 when 'blocks' then 5 end, -1) then 'name_fields'
when kind = 'str_reads' and not ({_match_ok(2, False)} and {_match_ok(6, False)}) then 'name_values'
when kind = 'blocks' and not {_match_ok(2, True)} then 'name_values' end reason from e)"""
SQL["p6_found"] = _P6 + " select rec_id, reason from r where reason is not null"


@query
def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    """The records that parse, as columns."""
    return records.valid(table(spark, d, "raw_records"))


SQL["p6_valid"] = _P6 + """ select rec_id, file_idx, kind, f[1] as name, case when kind != 'reads' then f[2] end as motif, case when kind != 'reads' then list_transform(string_split(f[3], ','), lambda x: x::int) end as copies,
case when kind != 'reads' then f[4]::int end as start, case when kind != 'reads' then f[5]::int end as "end", case when kind = 'str_reads' then f[6] end as rc_motif, case when kind = 'str_reads' then f[7]::int end as rc_copies,
case when kind = 'str_reads' then f[8]::int end as rc_start, case when kind = 'str_reads' then f[9]::int end as rc_end, l[2] as seq, l[4] as qual from r where reason is null"""
