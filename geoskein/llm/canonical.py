"""Freely typed values mapped to the closest entry of a reference list: a partition-based pigeonhole join, SQL only.

A string within k edits of an entry cut into k+1 segments holds at least one segment unchanged, at most k places from
where it stands in the entry.  So the segments of all entries are joined by equality with the substrings of the typed
values at those places, and only the pairs found are verified with the built-in ``levenshtein``.  Values without a
verified entry come out of an anti-join.

Typed values carry words around the name, other word orders and separators.  They are therefore folded to plain
letters and compared through their windows: runs of neighbouring words, also with an outer word moved to the other
end, written without spaces.  Entries also stand with their letters above ASCII dropped.  A value has up to three
readings besides its own: decoded again where its characters are the bytes of UTF-8 text (``decoded``, layer by
layer), and with words replaced by the entry words they stand for.  Such replacements are not given but found in the
data: a word that fills the gap of one and the same word in ``SUPPORT`` different entries, or contracts the missing
word to its first, last and some other letters.  In short entries three edits must leave most letters alike, so that a swap of
neighbours, two edits, weighs less than two other letters.  All work is on distinct values and distinct windows,
joined back to the records at the end.

Defined results: NULL, blank and exact values are not asked for; ties go to fewer edits, then to the longer entry,
then to the smaller id; repeated records all come out; an empty reference list leaves every value unmatched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoskein.plans.session import cut

#: Most edits for an entry of so many folded letters: up to 4, up to 7, up to 11, beyond.  A transposition is two edits.
EDITS = ((4, 1), (7, 2), (11, 3), (10**9, 4))
MOST_EDITS = EDITS[-1][1]
#: For entries of up to so many letters, three edits may leave at most two letters different, whatever their order.
SHORT, SHORT_LETTERS = 11, 2
#: Entries whose same gap a word must fill to stand for the entry's word.
SUPPORT = 3
#: Layers of wrong decoding that are undone.
LAYERS = 3
# Decoders commonly applied to the bytes of UTF-8 text.
DECODERS = ("cp1252", "cp437", "cp850", "mac_roman")

_FOLD_FROM = "áàâäãåéèêëíìîïóòôöõøúùûüýÿñç"
_FOLD_TO = "aaaaaaeeeeiiiioooooouuuuyync"


def folded(column: str) -> str:
    """SQL: lower case, marks and ligatures folded (also when written out, as in aa, ae, oe), other signs to single spaces."""
    text = f"lower({column})"
    text = f"regexp_replace({text}, '[\\\\u0300-\\\\u036f]', '')"
    text = f"translate({text}, '{_FOLD_FROM}', '{_FOLD_TO}')"
    text = f"regexp_replace(regexp_replace(regexp_replace({text}, 'æ|ae|aa', 'a'), 'œ|oe', 'o'), 'ß', 'ss')"
    return f"trim(regexp_replace({text}, '[^a-z0-9\\\\ufffd]+', ' '))"


def edits(length: str) -> str:
    return "case " + " ".join(f"when {length} <= {most} then {k}" for most, k in EDITS) + " end"


def letters_apart(a: str, b: str) -> str:
    """SQL: letters of one string that the other lacks, with multiplicity, whatever their order; the larger of both ways."""

    def lacking(x: str, y: str) -> str:
        count = lambda s: f"(length({s}) - length(replace({s}, c, '')))"
        return f"aggregate(split('abcdefghijklmnopqrstuvwxyz0123456789', ''), 0, (n, c) -> n + if(c = '', 0, greatest(0, {count(x)} - {count(y)})))"

    return f"greatest({lacking(a, b)}, {lacking(b, a)})"


def decoded(text: str, decoder: str) -> str:
    """SQL: the text whose UTF-8 bytes ``decoder`` shows as the given characters, or NULL where they are not such bytes."""
    shown, bytes_ = "", ""
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(decoder)
        except UnicodeDecodeError:
            continue  # an undefined byte stands for itself
        if ch != chr(b):
            shown, bytes_ = shown + ch, bytes_ + f"\\u{b:04x}"
    quoted = shown.replace("\\", "\\\\").replace("'", "\\'")
    as_bytes = f"translate({text}, '{quoted}', '{bytes_}')"
    again = f"cast(encode({as_bytes}, 'ISO-8859-1') as string)"
    return f"case when {text} rlike '[^\\\\x00-\\\\x7F]' and {as_bytes} rlike '^[\\\\x00-\\\\xFF]*$' then if(is_valid_utf8({again}), {again}, null) end"


def readings(values: DataFrame) -> DataFrame:
    """(field_name, value, reading) for each (field_name, value, text): the text, and what it is when decoded again, layer by layer."""
    spark = values.sparkSession
    plain = values.select("field_name", "value", F.col("text").alias("reading"))
    layer = values.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("field_name", "value", F.col("text").alias("reading"))
    every = [plain]
    for _ in range(LAYERS):
        options = ", ".join(decoded("reading", d) for d in DECODERS)
        layer = spark.sql(f"select field_name, value, explode(array_distinct(filter(array({options}), r -> r is not null))) as reading from {{layer}}", layer=layer)
        every.append(layer)
    out = every[0]
    for other in every[1:]:
        out = out.unionByName(other)
    return out


def replacements(texts: DataFrame, entries: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(field_name, word, stands_for): folded words of the readings (field_name, reading) that stand for a word of the entries.

    Either way a reading is an entry but for this word.  By substitution: so for ``support`` different entries with the
    same word missing and for other missing words less often.  By contraction: the word has two to four letters,
    consonants after the first, and the missing one, at least twice as long, holds them in this order between the same
    outer letters.
    """
    return texts.sparkSession.sql(
        f"""
        with entry_words as (
            select distinct field_name, canonical_id, split({folded("canonical_value")}, ' ') as ws from {{entries}}),
        listed as (select distinct field_name, explode(ws) as word from entry_words),
        gaps as (
            select field_name, canonical_id, posexplode(ws) as (i, word), ws from entry_words where size(ws) > 1),
        entry_gaps as (
            select field_name, canonical_id, word, array_join(transform(ws, (w, j) -> if(j = i, '*', w)), ' ') as frame from gaps),
        longest as (select max(size(ws)) as m from entry_words),
        read as (
            select distinct field_name, split({folded("reading")}, ' ') as ws from {{texts}}),
        short as (select field_name, ws from read cross join longest where size(ws) between 2 and m),
        typed_gaps as (
            select field_name, word, array_join(transform(ws, (w, j) -> if(j = i, '*', w)), ' ') as frame
            from (select field_name, posexplode(ws) as (i, word), ws from short)),
        fills as (
            select t.field_name, t.word, e.word as stands_for, count(distinct e.canonical_id) as n
            from typed_gaps t join entry_gaps e on t.field_name = e.field_name and t.frame = e.frame
            group by t.field_name, t.word, e.word),
        substituted as (
            select field_name, word, max_by(stands_for, n) as stands_for from fills
            group by field_name, word having max(n) >= {support} and max(n) > sum(n) - max(n)),
        contracted as (
            select field_name, word, min(stands_for) as stands_for from fills
            where length(word) between 2 and 4 and substring(word, 2) not rlike '[aeiouy]' and length(stands_for) >= 2 * length(word)
              and substring(word, 1, 1) = substring(stands_for, 1, 1) and right(word, 1) = right(stands_for, 1)
              and stands_for like array_join(filter(split(word, ''), c -> c != ''), '%')
            group by field_name, word having count(distinct stands_for) = 1),
        found as (select * from substituted union all select c.* from contracted c left anti join substituted s on c.field_name = s.field_name and c.word = s.word)
        select f.field_name, f.word, f.stands_for from found f left anti join listed l on f.field_name = l.field_name and f.word = l.word""",
        texts=texts, entries=entries,
    )


def segments(entries: DataFrame, replaced: DataFrame) -> DataFrame:
    """(field_name, canonical_id, flat, k, seg, start, size, piece) of each form of each entry (field_name, canonical_id, canonical_value).

    A word of the data that stands for one of the entry and is no misspelling of it makes a form of its own, so that
    its misspellings are found as well.
    """
    plain = folded("canonical_value")
    dropped = folded("regexp_replace(canonical_value, '[^\\\\x00-\\\\x7F]', '')")
    return entries.sparkSession.sql(
        f"""
        with forms as (
            select field_name, canonical_id, size(split({plain}, ' ')) as n_words, explode(array({plain}, {dropped})) as form from {{entries}}
            union all
            select e.field_name, canonical_id, size(ws), array_join(transform(ws, w -> if(w = r.stands_for, r.word, w)), ' ')
            from (select field_name, canonical_id, split({plain}, ' ') as ws from {{entries}}) e
            join {{replaced}} r on e.field_name = r.field_name and array_contains(ws, r.stands_for)
            where levenshtein(r.word, r.stands_for) > 2),
        flat as (
            select distinct field_name, canonical_id, n_words, replace(form, ' ', '') as flat from forms),
        sized as (select *, least({edits("length(flat)")}, length(flat) - 1) as k from flat where length(flat) > 0),
        cut as (
            select *, explode(sequence(0, k)) as seg, div(length(flat), k + 1) as base, length(flat) % (k + 1) as longer from sized)
        select field_name, canonical_id, flat, n_words, length(flat) as len, cast(k as int) as k, seg,
               cast(seg * base + greatest(0, seg - (k + 1 - longer)) + 1 as int) as start,
               cast(base + if(seg >= k + 1 - longer, 1, 0) as int) as size,
               substring(flat, cast(seg * base + greatest(0, seg - (k + 1 - longer)) + 1 as int),
                         cast(base + if(seg >= k + 1 - longer, 1, 0) as int)) as piece
        from cut""",
        entries=entries, replaced=replaced,
    )


def windows(texts: DataFrame, replaced: DataFrame, most_words: int) -> DataFrame:
    """(field_name, value, flat) for each run of up to ``most_words`` words of the folded readings (field_name, value, reading).

    Also for each run with its last word in front or its first word behind, and with its words ``replaced``.
    """
    return texts.sparkSession.sql(
        f"""
        with own as (
            select field_name, value, filter(split({folded("reading")}, ' '), w -> w != '') as ws from {{texts}}),
        maps as (  -- words of the list and their replacements, one small map per field
            select field_name, map_from_entries(collect_list(struct(word, stands_for))) as m from {{replaced}} group by field_name),
        words as (
            select distinct field_name, value, explode(array(ws, if(m is null, ws, transform(ws, w -> coalesce(m[w], w))))) as ws
            from own left join maps using (field_name)),
        begun as (
            select field_name, value, ws, explode(sequence(1, size(ws))) as a from words where size(ws) > 0),
        ended as (
            select field_name, value, ws, a, explode(sequence(a, least(a + {most_words - 1}, size(ws)))) as b from begun),
        runs as (
            select field_name, value, array_join(filter(ws, (w, i) -> i + 1 between a and b), '') as plain,
                   concat(element_at(ws, b), array_join(filter(ws, (w, i) -> i + 1 >= a and i + 1 < b), '')) as last_first,
                   concat(array_join(filter(ws, (w, i) -> i + 1 > a and i + 1 <= b), ''), element_at(ws, a)) as first_last
            from ended)
        select distinct field_name, value, explode(array_distinct(array(plain, last_first, first_last))) as flat
        from runs""",
        texts=texts, replaced=replaced,
    )


def closest_entries(values: DataFrame, entries: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(field_name, value, canonical_id, distance) of each distinct (field_name, value, text) that has an entry within its edits."""
    spark = values.sparkSession
    texts = cut(readings(values))
    replaced = cut(replacements(texts, entries, support))
    segs = cut(segments(entries, replaced))
    # one number: the longest entry in words bounds the windows; a typed word may be split in two
    most = (segs.agg(F.max("n_words")).first()[0] or 0) + 2
    wins = cut(windows(texts, replaced, most))  # used twice: written once
    return spark.sql(
        f"""
        with plans as (select distinct field_name, len, k, seg, start, size from {{segs}}),
        probes as (select distinct field_name, flat from {{wins}}),
        reach as (  -- a typed length meets the entry lengths at most {MOST_EDITS} away by equality
            select field_name, flat, explode(sequence(length(flat) - {MOST_EDITS}, length(flat) + {MOST_EDITS})) as len from probes),
        places as (
            select r.field_name, r.flat, r.len, p.seg, p.size,
                   explode(sequence(greatest(1, p.start - p.k), least(length(r.flat) - p.size + 1, p.start + p.k))) as at
            from reach r join plans p on r.field_name = p.field_name and r.len = p.len
            where abs(length(r.flat) - p.len) <= p.k and greatest(1, p.start - p.k) <= least(length(r.flat) - p.size + 1, p.start + p.k)),
        pairs as (
            select distinct l.field_name, l.flat, s.flat as entry, s.canonical_id, s.k
            from places l join {{segs}} s
              on l.field_name = s.field_name and l.len = s.len and l.seg = s.seg and substring(l.flat, l.at, l.size) = s.piece),
        near as (
            select field_name, flat, entry, canonical_id, length(entry) as len, levenshtein(flat, entry, k) as distance from pairs),
        alike as (
            select * from near where distance >= 0
            and (distance < 3 or len > {SHORT} or {letters_apart("flat", "entry")} <= {SHORT_LETTERS})),
        best as (
            select field_name, flat, min(struct(distance, -len as short, canonical_id)) as b from alike group by field_name, flat)
        select w.field_name, w.value, min(b).canonical_id as canonical_id, min(b).distance as distance
        from {{wins}} w join best on w.field_name = best.field_name and w.flat = best.flat
        group by w.field_name, w.value""",
        segs=segs, wins=wins,
    )


def map_to_entries(values: DataFrame, entries: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Each distinct (field_name, value, text) with its ``canonical_id``, or 0 where no entry is near enough."""
    matched = closest_entries(values, entries, support).select("field_name", "value", "canonical_id")
    unmatched = values.select("field_name", "value").join(matched, ["field_name", "value"], "left_anti")
    return matched.unionByName(unmatched.select("field_name", "value", F.lit(0).cast("long").alias("canonical_id")))
