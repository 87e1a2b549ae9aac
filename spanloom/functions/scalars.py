"""Column functions: times, ranges, titles, texts, prices, tool logs, names. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- times


def timecode(seconds: Column) -> Column:
    """HH:MM:SS of seconds rounded half to even, 0 at least."""
    t = F.greatest(F.lit(0), F.bround(seconds).cast("long"))
    return _clock(t)


def preview_timecode(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds passed."""
    return _clock(F.floor(seconds).cast("long"))


def _clock(t: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60)


def parse_time(text: Column) -> Column:
    """Seconds of 'h:m:s', 'm:s' or a number; 0 for null and blank; null for anything else."""
    part = F.transform(F.split(F.trim(text), ":"), lambda x: x.try_cast("double"))
    n = F.size(part)
    value = F.when(n == 1, F.get(part, 0)).when(n == 2, F.get(part, 0) * 60 + F.get(part, 1)).when(n == 3, F.get(part, 0) * 3600 + F.get(part, 1) * 60 + F.get(part, 2))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(0.0)).otherwise(value)


def log_duration(text: Column) -> Column:
    """Seconds of the first 'Duration: h:m:s.f' in a tool's output, or null."""
    p = r"Duration:\s*([0-9]+):([0-9]+):([0-9]+(?:\.[0-9]+)?)"
    part = lambda k: F.regexp_extract(text, p, k).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def fraction(text: Column) -> Column:
    """'n/d' or a number as double; null if it is neither or d is 0."""
    top, under = F.get(F.split(text, "/", 2), 0).try_cast("double"), F.get(F.split(text, "/", 2), 1).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), F.try_divide(top, under)).otherwise(text.try_cast("double"))


# --- indices and ranges


def confidence(text: Column) -> Column:
    """A number clamped to 0..1; 0.5 for what is none."""
    return F.least(F.greatest(F.coalesce(text.try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def index_list(texts: Column) -> Column:
    """Integers of an array of texts, in order, each once; what is none drops out."""
    return F.array_distinct(F.array_compact(F.transform(texts, lambda x: F.when(~F.lower(x).isin("true", "false"), x.try_cast("bigint")))))


def expand_ranges(ranges: Column) -> Column:
    """Indices of an array of (lo, hi), in order, each once; negative and reversed pairs drop out."""
    good = F.filter(ranges, lambda r: (r["lo"] >= 0) & (r["lo"] <= r["hi"]))
    return F.array_distinct(F.flatten(F.transform(good, lambda r: F.sequence(r["lo"], r["hi"]))))


def clamp_ranges(ranges: Column, size: Column) -> Column:
    """Ranges cut to 0..size-1, sorted; what is reversed then drops out."""
    cut = F.transform(ranges, lambda r: F.struct(F.greatest(r["lo"], F.lit(0).cast("long")).alias("lo"), F.least(r["hi"], size - 1).alias("hi")))
    return F.sort_array(F.filter(cut, lambda r: r["lo"] <= r["hi"]))


def range_indices(ranges: Column) -> Column:
    """Sorted distinct indices of ranges."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"])))))


def valid_indices(indices: Column, size: Column) -> Column:
    """Sorted distinct indices inside 0..size-1."""
    return F.sort_array(F.array_distinct(F.filter(indices, lambda i: (i >= 0) & (i < size))))


def index_runs(indices: Column) -> Column:
    """Maximal runs of consecutive numbers in a sorted array of distinct ones, as (lo, hi)."""
    starts = F.filter(indices, lambda x, i: (i == 0) | (x != F.get(indices, i - 1) + 1))
    ends = F.filter(indices, lambda x, i: (i == F.size(indices) - 1) | (x != F.coalesce(F.get(indices, i + 1), x) - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))


# --- titles

#: Prefixes of titles that name nothing, and titles an audit never accepts.
UNNAMED = "未知歌曲"
UNKNOWN_PREFIXES = ("未知歌曲", "unknown")
INVALID_TITLES = ("", "unknown", "未知", "未知歌曲", "未知歌曲：代表歌词", "未知歌曲:代表歌词", "对话", "对话片段", "聊天", "聊天片段", "非歌曲", "无歌曲")


def title_key(title: Column) -> Column:
    return F.lower(F.trim(title))


def unknown_title(title: Column) -> Column:
    """Empty, or begins with an unknown prefix."""
    key = title_key(title)
    out = key == ""
    for p in UNKNOWN_PREFIXES:
        out = out | F.startswith(key, F.lit(p))
    return out


def unknown_prefix(title: Column) -> Column:
    """As unknown_title, but an empty title does not count."""
    return unknown_title(title) & (title_key(title) != "")


def named_title(title: Column) -> Column:
    """Not empty, and without the prefix of unnamed songs."""
    return (F.trim(title) != "") & ~F.startswith(F.trim(title), F.lit(UNNAMED))


def invalid_audit_title(title: Column) -> Column:
    return title_key(title).isin(*INVALID_TITLES)


def garbled(text: Column) -> Column:
    """Holds the replacement character."""
    return F.contains(text, F.lit("�"))


# --- severity of a described event


def described(severity: Column, scenario: Column, text: Column) -> Column:
    return F.concat(F.lit("[严重程度:"), severity.cast("string"), F.lit("/5][场景:"), scenario, F.lit("] "), text)


def described_parts(text: Column) -> Column:
    """(severity, scenario, description) of a description with prefixes; 0 and C where they lack."""
    severity = F.regexp_extract(text, r"\[严重程度:([0-9]+)/5\]", 1).try_cast("int")
    scenario = F.regexp_extract(text, r"\[场景:([ABC])\]", 1)
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, r"\[严重程度:[0-9]+/5\]\s*", ""), r"\[场景:[ABC]\]\s*", ""))
    return F.struct(F.coalesce(severity, F.lit(0)).cast("long").alias("severity"), F.when(scenario == "", "C").otherwise(scenario).alias("scenario"), rest.alias("description"))


def short_title(title: Column, description: Column, most: int = 19) -> Column:
    """The title, or else the description, with spaces squeezed, outer punctuation gone and a bounded length."""
    text = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.trim(description), F.lit(""))
    text = F.btrim(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(" ，。！？；：,.!?;:\"'“”‘’《》【】[]()（）"))
    return F.when(F.length(text) > most, F.rtrim(F.substring(text, 1, most), F.lit(" ，。！？；：,.!?;:"))).otherwise(text)


# --- texts


def language(text: Column) -> Column:
    """ja, zh or en by code-point ranges."""
    kana, han = F.regexp_count(text, F.lit("[぀-ヿ]")), F.regexp_count(text, F.lit("[一-鿿]"))
    return F.when(kana > 2, "ja").when(han > F.length(text) * 0.2, "zh").otherwise("en")


def lyric_query(title: Column, artist: Column) -> Column:
    suffix = F.when(language(title) == "zh", "歌词").when(language(title) == "ja", "歌詞").otherwise("lyrics")
    return F.concat_ws(" ", F.nullif(artist, F.lit("")), title, suffix)


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def lyric_of(snippet: Column) -> Column:
    """The first quoted run of ten characters or more, or else the first five longer lines that are no addresses; null if none."""
    quoted = F.regexp_extract(snippet, '"([^"]{10,})"', 1)
    lines = F.filter(F.transform(F.split(snippet, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 5) & ~x.rlike("^(http|www|©)"))
    return F.when(quoted != "", quoted).when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, 5), "\n"))


def text_tokens(text: Column) -> Column:
    """Distinct tokens: pairs of characters of mostly Han texts, else lower-case words of letters only."""
    han = F.regexp_count(text, F.lit("[一-鿿]")) > F.length(text) * 0.3
    clean = F.lower(F.regexp_replace(text, "[^一-鿿\\w]", ""))
    pairs = F.when(F.length(clean) > 1, F.transform(F.sequence(F.lit(1), F.length(clean) - 1), lambda i: F.substring(clean, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    return F.array_distinct(F.when(han, pairs).otherwise(words))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set's; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def transcript_line(idx: Column, start: Column, end: Column, text: Column) -> Column:
    return F.format_string("[%d] (%.1f-%.1f) %s", idx, start, end, text)


#: Traditional characters and their simplified forms.
SIMPLIFIED = {
    "說": "说", "見": "见", "聽": "听", "後": "后", "裡": "里", "國": "国", "會": "会", "這": "这", "們": "们", "時": "时", "間": "间", "愛": "爱", "戀": "恋", "陽": "阳", "陰": "阴", "雲": "云", "風": "风", "車": "车", "長": "长", "廣": "广",
    "華": "华", "樂": "乐", "歡": "欢", "離": "离", "難": "难", "夢": "梦", "憶": "忆", "憂": "忧", "鬱": "郁", "淚": "泪", "聲": "声", "響": "响", "體": "体", "關": "关", "開": "开", "門": "门", "問": "问", "題": "题", "頭": "头",
    "臉": "脸", "發": "发", "現": "现", "實": "实", "無": "无", "為": "为", "與": "与", "從": "从", "來": "来", "個": "个", "倆": "俩", "麼": "么", "麗": "丽", "點": "点", "線": "线", "經": "经", "過": "过", "還": "还", "進": "进", "遠": "远", "邊": "边", "裏": "里",
}


def canonical_title(title: Column, characters: dict[str, str] = SIMPLIFIED) -> Column:
    """Trimmed, character by character in its simplified form."""
    return F.translate(F.trim(title), "".join(characters), "".join(characters.values()))


#: Words that titles of web pages add, and what is cut off a title, in this order. The middle two apply to titles with a Han character.
PAGE_WORDS = "lyrics|歌词|MV|Official|Audio|HD|歌詞|高清|现场|Live"
PAGE_TAILS = (
    rf"\s*\(.*?({PAGE_WORDS}).*?\)\s*$",
    rf"\s*[-–—|]\s*({PAGE_WORDS})(\s+({PAGE_WORDS}))*\s*$",
    rf"\s+({PAGE_WORDS})(\s+({PAGE_WORDS}))*\s*$",
    r"\s+With\s+\w+\s+By\s+.*$",
    r"\s+歌詞.*$",
)
HAN_TAIL, HAN_HEAD = r"\s+The\s+\w+(\s+\w+)*$", r"^[A-Za-z][A-Za-z\s]+([一-鿿])"
SITE_TAILS = (
    r"\s*[-–—|]\s*TikTok\s*$",
    r"\s*[-–—|]\s*Shazam\s*$",
    r"\s*[-–—|]\s*Spotify\s*$",
    r"\s*[-–—|]\s*YouTube\s*$",
    r"\s*[-–—|]\s*KKBOX\s*$",
    r"\s*[-–—|]\s*Genius\s*$",
    r"\s*[-–—|]\s*AZLyrics\.com\s*$",
    r"\s*[-–—|]\s*JustSomeLyrics\s*$",
    r"\s*[-–—|]\s*hymnal\.net\s*$",
    r"\s+Song Lyrics, Music Videos & Concerts\s*$",
    r"\s+Music Videos & Concerts\s*$",
    r"\s+arranged by\s+.*$",
    r"\s*\|\s*Genius\s*$",
    r"\s*\|\s*AZLyrics\.com\s*$",
    r"\s*\(book\)\s*$",
)


def page_title(title: Column) -> Column:
    """A web page's title without what the site adds; null stays null."""
    for tail in PAGE_TAILS:
        title = F.regexp_replace(title, "(?iU)" + tail, "")
    title = F.when(title.rlike("[一-鿿]"), F.regexp_replace(title, "(?iU)" + HAN_TAIL, "")).otherwise(title)
    title = F.when(title.rlike("[一-鿿]"), F.trim(F.regexp_replace(title, HAN_HEAD, "$1"))).otherwise(title)
    for tail in SITE_TAILS:
        title = F.regexp_replace(title, "(?iU)" + tail, "")
    return F.trim(F.regexp_replace(title, r"(?U)\s+", " "))


# --- tokens and prices

#: Dollars for a million tokens, tokens for a character, and the phases of a log path.
PRICE_HIT, PRICE_MISS, PRICE_OUT, TOKENS_PER_CHAR = 0.0028, 0.14, 0.28, 0.62
LOG_PHASES = (
    ("v3/discovery/", "v3_discovery"),
    ("v3/recall_audit/", "v3_recall_audit"),
    ("v3/adjudication/", "v3_adjudication"),
    ("temporal_adjudication/", "temporal_adjudication"),
    ("review/before_missed_recheck/", "review_before"),
    ("review/after_missed_recheck/", "review_after"),
    ("overlong_recheck/", "overlong"),
    ("missed_recheck/", "missed_recheck"),
)


def log_phase(path: Column) -> Column:
    out, path = F.lit("main"), F.replace(path, F.lit("\\"), F.lit("/"))
    for prefix, phase in LOG_PHASES[::-1]:
        out = F.when(F.startswith(path, F.lit(prefix)), phase).otherwise(out)
    return out


def tokens_of(chars: Column, ratio: float = TOKENS_PER_CHAR) -> Column:
    return F.when(chars <= 0, 0).otherwise(F.greatest(F.lit(1), F.floor(chars * F.lit(ratio)))).cast("long")


def price(hit: Column, miss: Column, out: Column) -> Column:
    return hit * PRICE_HIT / 1e6 + miss * PRICE_MISS / 1e6 + out * PRICE_OUT / 1e6


# --- tool logs

#: Messages of a broken video stream.
BITSTREAM = (
    "Invalid NAL", "missing picture", "decode_slice_header", "h264_mp4toannexb.*(fail|error)", "hevc_mp4toannexb.*(fail|error)", "Error applying bitstream filters",
    "non-existing PPS", "bytestream overread", "error while decoding MB", r"\bno frame\b", "corrupt decoded frame",
)
#: Words in lower case, one of which stands in every output that BITSTREAM tells of.
BITSTREAM_MARKS = ("invalid nal", "missing picture", "decod", "mp4toannexb", "bitstream", "existing pps", "overread", "no frame")
#: Other problems in the order they are reported; for each, patterns with marks of which an output that fits holds one. Patterns that are None are told by their marks.
PROBLEMS = (
    ("timestamp_discontinuity", ((None, ("invalid dts", "negative ts", "timestamp")), ("non.?monotonic", ("monotonic",)), ("pts.*(invalid|discontinu)", ("pts",)))),
    ("duration_truncated", ((r"concat output (video stream )?duration is too (short|long)", ("duration is too ",)),)),
    ("audio_decode_fail", ((r"audio.*(not decodable|fail|error|invalid|corrupt)|aac.*(decode|error|invalid|corrupt)", ("audio", "aac")),)),
    ("hw_unavailable", ((r"(unknown encoder|encoder not found|device.*not found|nvenc|qsv|amf).*(fail|error|unavailable|not)", ("encoder", "device", "nvenc", "qsv", "amf")),)),
    ("demux_error", ((None, ("demux", "error opening input", "moov atom not found", "partial file", "invalid data found when processing input")),)),
)


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in marks))


def bitstream_broken(text: Column) -> Column:
    return _holds(F.lower(text), BITSTREAM_MARKS) & text.rlike("(?i)" + "|".join(BITSTREAM))


def log_problems(text: Column) -> Column:
    """Names of the problems a tool's output tells of. Patterns are tried where one of their marks stands."""
    low = F.lower(text)
    fits = lambda p, marks: _holds(low, marks) & low.rlike(p) if p else _holds(low, marks)
    named = [F.when(bitstream_broken(text), F.lit("bitstream_corruption"))] + [F.when(reduce(Column.__or__, (fits(*p) for p in patterns)), F.lit(n)) for n, patterns in PROBLEMS]
    return F.array_except(F.array(*named), F.array(F.lit(None).cast("string")))  # not array_compact, whose lambda would have the text put in lower case for every mark


def log_segments(text: Column) -> Column:
    """Zero-based numbers of the segments an output names, sorted."""
    lists = F.regexp_extract_all(text, F.lit(r"(?i)segment\(s\)\s*([0-9,\s]+)"), F.lit(1))
    numbers = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))))
    found = F.sort_array(F.array_distinct(F.transform(numbers, lambda n: F.greatest(F.lit(0).cast("long"), n.cast("long") - 1))))
    return F.when(~_holds(F.lower(text), ("segment(s)",)), F.array().cast("array<bigint>")).otherwise(found)


def failed_duration(text: Column) -> Column:
    """Seconds of the output that a failed join reports, or null."""
    p = "(?i)Concat output {}duration is too short:\\s*([0-9.]+)s"
    return F.when(_holds(F.lower(text), ("duration is too short:",)), F.coalesce(*(F.regexp_extract(text, p.format(x), 1).try_cast("double") for x in ("video stream ", ""))))


# --- names


def valid_date(text: Column) -> Column:
    """Six digits YYMMDD with a month and a day."""
    return text.rlike("^[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$")


def date_in(text: Column) -> Column:
    """The first date in a text: YYYY-MM-DD or YYYY_MM_DD before six digits that stand alone; YYMMDD, or null."""
    long = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4}[-_][0-9]{2}[-_][0-9]{2})(?![0-9])"), F.lit(1)), lambda x: F.substring(F.regexp_replace(x, "[-_]", ""), 3, 6))
    short = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{6})(?![0-9])"), F.lit(1))
    return F.get(F.filter(F.concat(long, short), valid_date), 0)


def name_part(text: Column) -> Column:
    """A part of a file name: no replacement or reserved characters, spaces squeezed; 'untitled' if nothing is left."""
    clean = F.translate(F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("�"), F.lit(""))), '<>:"/\\|?*', "_" * 9)
    clean = F.btrim(F.regexp_replace(clean, r"\s+", " "), F.lit(" .-_"))
    return F.when(clean == "", "untitled").otherwise(clean)


def clip_stem(streamer: Column, title: Column, artist: Column, date: Column) -> Column:
    """【streamer】title[-artist]-date."""
    a = name_part(artist)
    parts = F.concat_ws("-", name_part(title), F.when(a != "untitled", a), date)
    return F.concat(F.lit("【"), name_part(streamer), F.lit("】"), parts)


def plain_stem(index: Column, title: Column, artist: Column) -> Column:
    """NNN-title[-artist]."""
    return F.concat_ws("-", F.format_string("%03d", index), title, F.nullif(artist, F.lit("")))


def stem_parts(stem: Column) -> Column:
    """(title, artist) of a stem: prefix, date and number go; ' - ' divides, or else the last '-'."""
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "^【[^】]*】", ""), r"-[0-9]{6}$", ""), r"^[0-9]{3}-", "")
    wide, dash = F.contains(core, F.lit(" - ")), F.contains(core, F.lit("-"))
    title = F.when(wide, F.substring_index(core, " - ", 1)).when(dash, F.regexp_extract(core, "^(.*)-[^-]*$", 1)).otherwise(core)
    artist = F.when(wide, F.regexp_extract(core, "^.*? - (.*)$", 1)).when(dash, F.substring_index(core, "-", -1)).otherwise("")
    return F.struct(F.trim(title).alias("title"), F.trim(artist).alias("artist"))
