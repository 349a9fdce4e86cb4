"""Column expressions over strings, urls, paths and parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import col

# Characters that Python's str.strip() takes off, as a regular expression class.
_BLANK = r"[\s\x1c-\x1f\x85\xa0  -     　]"


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends; SQL's trim takes spaces only."""
    return F.regexp_replace(col(x), f"^{_BLANK}+|{_BLANK}+$", "")


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(x) for x in xs))


def fixed6(x: Column | str) -> Column:
    """Six decimals without trailing zeros or point; null and NaN give an empty string. For export only: rounds half up on the decimal digits."""
    v = col(x)
    text = F.regexp_replace(F.format_string("%.6f", v.cast("double")), r"\.?0+$", "")
    return F.when(v.isNull() | F.isnan(v.cast("double")), "").otherwise(text)


# Patterns of post urls, in the order in which they are tried.
PLATFORMS = [
    ("youtube", r"(?:https?://)?(?:www\.)?(?:youtube\.com/watch\?v=|youtu\.be/)([A-Za-z0-9_-]{6,})"),
    ("reddit", r"(?:https?://)?(?:www\.)?reddit\.com/(?:r/[^/]+/comments|comments)/([a-z0-9]{5,10})"),
    ("telegram", r"(?:https?://)?t\.me/(?:c/)?[^/]+/(\d+)"),
]


def platform(url: Column | str) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(PLATFORMS):
        out = F.when(F.coalesce(col(url), F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def post_id(url: Column | str) -> Column:
    """The platform's id of a post; the url itself where no platform's pattern is found."""
    u = F.coalesce(col(url), F.lit(""))
    out = u
    for _, pattern in reversed(PLATFORMS):
        out = F.when(u.rlike(pattern), F.regexp_extract(u, pattern, 1)).otherwise(out)
    return out


def posting_id(posting: Column | str, platform_: Column | str, post: Column | str, default: str = "reddit") -> Column:
    """posting_id if filled, else platform:post_id, else null."""
    p = blank_to_null(post)
    return F.coalesce(blank_to_null(posting), F.when(p.isNotNull(), F.concat(first_filled(platform_, F.lit(default)), F.lit(":"), p)))


def bare_id(posting: Column | str) -> Column:
    """What follows the first colon, or the whole id."""
    p = col(posting)
    return F.when(F.instr(p, ":") > 0, F.substring(p, F.instr(p, ":") + 1, F.length(p))).otherwise(p)


def with_platform(id_: Column | str, default: str = "reddit") -> Column:
    i = col(id_)
    return F.when(F.instr(i, ":") > 0, i).otherwise(F.concat(F.lit(f"{default}:"), i))


def scheme(url: Column | str) -> Column:
    u = col(url)
    return F.when(F.instr(u, ":") > 0, F.substring_index(u, ":", 1))


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


# Public suffixes of two labels that the registrable domain is told by; any other suffix counts as one label.
SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "net.au", "or.jp", "org.au", "org.uk"]


def registrable_domain(host_: Column | str) -> Column:
    """One label more than the public suffix, by the short table SUFFIXES."""
    parts = F.split(col(host_), r"\.")
    n = F.when(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").isin(SUFFIXES), 3).otherwise(2)
    return F.when(col(host_).isNotNull(), F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "."))


def normal_key(path: Column | str, anchors: list[str] | None = None) -> Column:
    """The part of a path after the first anchor folder (in the anchors' order), else its last four parts, else its last part."""
    anchors = anchors if anchors is not None else ["Celeb-DF-v2", "FaceForensics++"]
    s = F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), "^/+", "")
    parts = F.split(s, "/")
    out = F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), 4), "/")).otherwise(F.element_at(parts, -1))
    for a in reversed(anchors):
        at = F.instr(s, f"/{a}/")
        out = F.when(at > 0, F.regexp_replace(F.substring(s, at + len(a) + 2, F.length(s)), "^/+", "")).otherwise(out)
    return out


def registrable_domains(df: DataFrame, rules: DataFrame, host_: str, to: str = "domain") -> DataFrame:
    """df with the registrable domain of its hosts by a table `rules` of public suffixes (rule: co.uk, *.ck, !www.ck): one label more than the longest rule that fits, null of a suffix itself. Without a rule the last label is the suffix."""
    parts = F.split(F.lower(F.regexp_replace(F.col("_h"), r"\.+$", "")), r"\.")
    tail = lambda i: F.array_join(F.slice(F.col("_p"), i, 1000), ".")
    hosts = df.select(F.col(host_).alias("_h")).where(F.col("_h").isNotNull()).distinct().withColumn("_p", parts)
    tails = hosts.select("_h", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_i")).withColumn("_t", tail(F.col("_i")))
    # An exception names the domain itself, so its suffix is one label shorter; a wildcard's is one label longer.
    exact = rules.where("rule NOT LIKE '*.%' AND rule NOT LIKE '!%'").select(F.col("rule").alias("_t"), F.lit(0).alias("_d"))
    wild = rules.where("rule LIKE '*.%'").select(F.expr("substring(rule, 3)").alias("_t"), F.lit(-1).alias("_d"))
    other = rules.where("rule LIKE '!%'").select(F.expr("substring(rule, 2)").alias("_t"), F.lit(1).alias("_d"))
    hit = tails.join(exact.unionByName(wild).unionByName(other), "_t").withColumn("_at", F.col("_i") + F.col("_d"))
    best = hit.groupBy("_h").agg(F.coalesce(F.min(F.when(F.col("_d") == 1, F.col("_at"))), F.min("_at")).alias("_at"))
    named = hosts.join(best, "_h", "left").withColumn("_at", F.coalesce("_at", F.size("_p")))
    domain = F.when(F.col("_at") > 1, tail(F.greatest(F.col("_at") - 1, F.lit(1))))
    return df.join(named.select("_h", domain.alias(to)), F.col(host_) == F.col("_h"), "left").drop("_h")


def clean_path(path: Column | str) -> Column:
    """Forward slashes, one at a time, no leading ./ and none at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^(\./+)+", ""), "/+", "/"), "(?<=.)/$", "")


def dataset_name(path: Column | str, root: str) -> Column:
    """The first folder of a path below root; empty where root isn't in it."""
    p, r = clean_path(path), root.rstrip("/")
    below = F.regexp_replace(F.substring(p, F.instr(p, r) + len(r), F.length(p)), "^/+", "")
    return F.when(F.instr(p, r) > 0, F.substring_index(below, "/", 1)).otherwise("")


def parent_folder(path: Column | str) -> Column:
    """Name of the folder that holds the file; null without one."""
    return F.try_element_at(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), F.lit(-2))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), -1), r"\.[^.]*$", "")


def mask_path(frame: Column | str) -> Column:
    return F.replace(col(frame), F.lit("frames"), F.lit("masks"))


def landmark_path(frame: Column | str) -> Column:
    return F.replace(F.replace(col(frame), F.lit("frames"), F.lit("landmarks")), F.lit(".png"), F.lit(".npy"))


def hash256(text: Column | str) -> Column:
    """The first 64 hexadecimal digits that stand by themselves, in lower case; null without."""
    return blank_to_null(F.lower(F.regexp_extract(col(text), r"\b([0-9a-fA-F]{64})\b", 1)))


def hash_lines(text: Column | str) -> Column:
    """Per line with a 256-bit hash: (ts, quality, hash). ts and quality are the first and last number of the whole line, digits of the hash included; quality is 0 with fewer than two."""
    lines = F.split(col(text), r"\r\n|\n|\r")

    def one(line: Column) -> Column:
        numbers = F.regexp_extract_all(line, F.lit(r"(\d+\.\d+|\d+)"), F.lit(1))
        return F.struct(
            F.coalesce(F.try_element_at(numbers, F.lit(1)).try_cast("double"), F.lit(0.0)).alias("ts"),
            F.when(F.size(numbers) >= 2, F.element_at(numbers, -1).try_cast("double")).otherwise(F.lit(0.0)).alias("quality"),
            hash256(line).alias("hash"),
        )

    return F.filter(F.transform(lines, one), lambda x: x["hash"].isNotNull())


def header(headers: Column | str, name: str) -> Column:
    """A header by its name as given, in lower case or in title case."""
    h = col(headers)
    return F.coalesce(*(F.try_element_at(h, F.lit(n)) for n in (name, name.lower(), name.title())))


def distinguished_name(cn: Column | str, o: Column | str, c: Column | str) -> Column:
    """CN=..; O=..; C=.. of those that are filled."""
    part = lambda k, x: F.when(blank_to_null(x).isNotNull(), F.concat(F.lit(f"{k}="), col(x)))
    return F.concat_ws("; ", part("CN", cn), part("O", o), part("C", c))


def last_wins_map(entries: Column | str, key: str = "key", value: str = "value") -> Column:
    """A map from an array of structs with these two fields; of equal keys the last one counts, whatever spark.sql.mapKeyDedupPolicy says."""
    e = col(entries)
    keys = F.array_distinct(F.transform(e, lambda x: x[key]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(e, lambda x: x[key] == k), -1)[value]))


_REPORT = "struct<manifests:array<struct<claimGenerator:string,assertions:array<string>,vendor:string>>,verification:struct<overall:string,isValid:boolean>,verifications:struct<overall:string,isValid:boolean>,vendor:string>"


def provenance_report(json: Column | str) -> Column:
    """claim_generator, assertions_count, valid and vendor of a signed-provenance report; all null where the text is no object."""
    object_ = F.when(strip(json).startswith("{"), col(json))
    r = F.from_json(object_, _REPORT)
    first = F.try_element_at(r["manifests"], F.lit(1))
    check = F.coalesce(r["verification"], r["verifications"])
    valid = F.coalesce(check["overall"].isin("OK", "VALID"), F.lit(False)) | F.coalesce(check["isValid"], F.lit(False))
    return F.struct(
        first["claimGenerator"].alias("claim_generator"),
        F.when(first.isNotNull(), F.coalesce(F.size(first["assertions"]), F.lit(0))).alias("assertions_count"),
        F.when(check.isNotNull(), valid).alias("valid"),
        first_filled(r["vendor"], first["vendor"]).alias("vendor"),
    )


def image_format(content: Column | str) -> Column:
    """Format of bytes by their first ones; pickled content is named, never loaded."""
    head = F.hex(F.substring(col(content), 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("934E554D5059"), "npy")
        .when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
        .when(head.startswith("80"), "pickle")
        .otherwise("unknown")
    )
