"""Generated notes and style prompts: checked against evidence, references and rules; repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_supported, once
from ..functions.text import DATE, MEDICAL_TERM, NUMBER, clean_scalar, is_generic, lines, match_normalize, sanitize_style, truncate_middle

#: Shortest reference line that counts as copied, keys of a style profile, length limits of its prompt.
COPIED = 28
STYLE_KEYS = ("professor", "style_summary", "length_policy", "content_priority", "strong_omit_rules", "format_rules", "abbreviation_rules", "unknown_policy", "style_prompt")
SHORTEST, LONGEST = 400, 3000
#: What a style prompt must say (lower case), and the line that says it where it does not.
DUTIES = (
    ("do not summarize the operative report", "- Do not summarize the operative report."),
    ("omit factual but low-priority", "- Omit factual but low-priority details that this professor leaves out."),
    ("current_row_facts", "- Patient facts come from CURRENT_ROW_FACTS only."),
)


def claims(note: Column, pattern: str) -> Column:
    """Sorted distinct matches that are not blank."""
    found = F.regexp_extract_all(note, F.lit(pattern), F.lit(0))
    return F.filter(F.array_sort(F.array_distinct(found)), lambda x: match_normalize(x) != "")


def _unknown(evidence: Column, is_date: bool):
    return (lambda x: ~date_supported(x, evidence)) if is_date else (lambda x: ~F.contains(evidence, match_normalize(x)))


def _labelled(label: str):
    return lambda x: F.concat(F.lit(label), x)


def note_warnings(note: Column, evidence: Column, opening: Column | None = None, style: Column | None = None) -> Column:
    """struct<warnings, unsupported> of a note against normalised evidence; dates count in any spelling."""
    none = F.array().cast("array<string>")
    patterns = {"date": DATE, "number": NUMBER, "medical_term": MEDICAL_TERM}
    shown = [] if style is None else [match_normalize(style).alias("style")]

    def found(x: Column) -> Column:
        bad = (F.filter(claims(x["text"], pattern), _unknown(x["evidence"], label == "date")).alias(label) for label, pattern in patterns.items())
        return once(F.struct(*bad), lambda y: told(x, y))

    def told(x: Column, bad: Column) -> Column:
        text, low = x["text"], F.lower(x["text"])
        out = [
            F.when(F.contains(low, F.lit("<think>")) | F.contains(low, F.lit("</think>")), F.array(F.lit("thinking tags in the note"))),
            F.when(F.contains(text, F.lit("```")), F.array(F.lit("code fence in the note"))),
        ]
        if opening is not None:
            lacks = F.coalesce((opening != "") & ~F.startswith(text, opening), F.lit(False))
            out.append(F.when(lacks, F.array(F.concat(F.lit("missing opening line: "), opening))))
        for label in patterns:
            out.append(F.transform(bad[label], _labelled(f"unsupported {label}: ")))
            if style is not None:
                leaked = F.filter(bad[label], lambda z: F.contains(x["style"], match_normalize(z)))
                out.append(F.transform(leaked, _labelled("leaked from the style prompt: ")))
        warnings = F.array_distinct(F.concat(*(F.coalesce(w, none) for w in out)))
        empty = text == ""
        return F.struct(
            F.when(empty, F.array(F.lit("the note is empty"))).otherwise(warnings).alias("warnings"),
            F.when(empty, none).otherwise(F.array_distinct(F.concat(*(bad[label] for label in patterns)))).alias("unsupported"),
        )

    # bound: a lambda would clean and normalise the whole texts anew for each claim
    return once(F.struct(clean_scalar(note).alias("text"), evidence.alias("evidence"), *shown), found)


#: Characters of a word by which lines of few words and notes meet: a line of COPIED characters and four words has one of seven.
GRAM = 7
#: Parameter: the most keys of reference lines that are sent to every task; with more, notes and lines are shuffled by key.
SENT_KEYS = 200_000
#: What is said of a note that copies a reference, and of one whose evidence lacks some of its facts; our own wording.
COPY, LEFT_OUT = "copied from the reference record_id=", "strict: some extracted facts were not sent"


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _line_keys(line: DataFrame) -> DataFrame:
    """line (professor, line) with a key that every text has which holds the line: three words in a row that stand inside a line of five
    words or more, the longest such; else the start, the end or a gram of the longest word, whose other side may be cut off."""
    words = F.split("line", " ")
    inner = F.transform(F.sequence(F.lit(2), F.greatest(F.size("_w") - 3, F.lit(2))), lambda i: F.array_join(F.slice("_w", i, F.lit(3)), " "))
    longest = lambda xs: F.array_max(F.transform(xs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    place = F.array_max(F.transform("_w", lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"))))["i"]
    word = F.get("_w", F.col("_at"))
    short = (
        F.when(F.size("_w") == 1, _hash(F.lit("gram"), F.left(word, F.lit(GRAM))))
        .when(F.col("_at") == 0, _hash(F.lit("end"), F.right(word, F.lit(GRAM))))
        .otherwise(_hash(F.lit("start"), F.left(word, F.lit(GRAM))))
    )
    out = line.withColumn("_w", words).withColumn("_at", place)
    return out.withColumn("key", F.when(F.size("_w") >= 5, _hash(F.lit("words"), longest(inner))).otherwise(short)).drop("_w", "_at")


def _text_keys(note: Column) -> Column:
    """array of the keys of a normalised text: each three words in a row, starts and ends of its words, grams of very long words."""

    def keys(w: Column) -> Column:
        three = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: _hash(F.lit("words"), F.array_join(F.slice(w, i, F.lit(3)), " ")))
        long = F.filter(F.array_distinct(w), lambda x: F.length(x) >= GRAM)
        ends = F.flatten(F.transform(long, lambda x: F.array(_hash(F.lit("start"), F.left(x, F.lit(GRAM))), _hash(F.lit("end"), F.right(x, F.lit(GRAM))))))
        whole = F.filter(long, lambda x: F.length(x) >= COPIED)
        grams = F.flatten(F.transform(whole, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - GRAM + 1), lambda i: _hash(F.lit("gram"), F.substring(x, i, F.lit(GRAM))))))
        return F.array_distinct(F.concat(three, ends, grams))

    return F.get(F.transform(F.array(F.split(note, " ")), keys), F.lit(0))  # the text is split once


def reference_leaks(notes: DataFrame, references: DataFrame) -> DataFrame:
    """(note_id, ref_id) where a line of a reference of the same professor stands in the note but not in its evidence.

    notes: note_id, professor, note, evidence; references: ref_id, professor, output. Lines and notes meet on 64-bit keys that no
    text can lack which holds the line, so neither are all compared with all nor are texts sent along with keys: texts are joined
    to the pairs that meet, each distinct line once, and containment is tested. Generic and short lines don't count.
    """
    line = references.select("ref_id", "professor", F.explode(F.transform(lines("output"), match_normalize)).alias("line"))
    line = line.where((F.length("line") >= COPIED) & ~is_generic(F.col("line"))).distinct()
    keyed = _line_keys(line.select("professor", "line").distinct()).withColumn("line_id", F.xxhash64("professor", "line"))
    text = notes.select("note_id", "professor", match_normalize("note").alias("_note"), F.col("evidence").alias("_evidence"))
    owner = F.col("professor")
    spans = text.select("note_id", F.explode(_text_keys(F.col("_note"))).alias("key"), owner)
    keys = keyed.select(owner, "key", "line_id")
    if keys.limit(SENT_KEYS + 1).count() <= SENT_KEYS:  # then no key of a note is shuffled
        keys = F.broadcast(keys)
    met = spans.join(keys, ["professor", "key"]).select("note_id", "professor", "line_id").distinct()
    both = met.join(text, ["note_id", "professor"]).join(keyed.select("line_id", owner, "line"), ["line_id", "professor"])
    held = both.where(F.contains("_note", F.col("line")) & ~F.contains("_evidence", F.col("line"))).select("note_id", "professor", "line").distinct()
    return held.join(line, ["professor", "line"]).select("note_id", "ref_id").distinct()


def excerpts(chosen: DataFrame, limit: int = 0) -> DataFrame:
    """professor, record_id, pick, output: the chosen references as a profile shows them, cut in their middle beyond limit > 0."""
    output = truncate_middle("output", limit, unescaped=False) if limit > 0 else F.col("output")
    return chosen.select("professor", "record_id", "pick", output.alias("output"))


def validated(rows: DataFrame, shown: DataFrame | None = None, strict: bool = False, opening: Column | None = None, style: Column | None = None, note: str = "generated_note") -> DataFrame:
    """rows (professor, evidence and a note) with w: struct<warnings, unsupported>, the whole validation of a note.

    After the warnings of note_warnings come, in the order of picks, the references among ``shown`` (excerpts) of the
    same professor of which the note has a line that its evidence lacks; then, if strict, that the evidence has fewer facts (n_sent)
    than were extracted (n_facts; rows without these columns are whole). An empty note has no other warning. Only
    hashes, notes and evidence go through the join; equal notes on equal evidence are tested once.
    """
    out = rows.withColumn("w", note_warnings(F.col(note), match_normalize("evidence"), opening, style))
    more = []
    if shown is not None:
        out = out.withColumn("_id", F.xxhash64(F.coalesce("professor", F.lit("")), F.coalesce(note, F.lit("")), F.coalesce("evidence", F.lit(""))))
        texts = out.select(F.col("_id").alias("note_id"), "professor", F.col(note).alias("note"), match_normalize("evidence").alias("evidence")).dropDuplicates(["note_id", "professor"])
        found = reference_leaks(texts, shown.select(F.struct("pick", "record_id").alias("ref_id"), "professor", "output"))
        found = found.groupBy(F.col("note_id").alias("_id")).agg(F.array_sort(F.collect_set("ref_id")).alias("_refs"))
        out = out.join(found, "_id", "left").drop("_id")
        more.append(F.transform("_refs", lambda x: F.concat(F.lit(COPY), x["record_id"])))
    if strict and {"n_sent", "n_facts"} <= set(rows.columns):
        more.append(F.when(F.col("n_sent") < F.col("n_facts"), F.array(F.lit(LEFT_OUT))))
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat("w.warnings", *(F.coalesce(x, none) for x in more)))
    every = F.when(clean_scalar(note) == "", F.col("w.warnings")).otherwise(every)
    return out.withColumn("w", F.col("w").withField("warnings", every)).drop("_refs")


def style_warnings(keys: Column, prompt: Column, abbreviation_rate: Column, stated: Column, professor: Column) -> Column:
    """What is wrong with a style profile: keys (array of those it has), its prompt and its professor."""
    text = clean_scalar(prompt)
    low = F.lower(text)
    out = [F.when(~F.array_contains(keys, F.lit(k)), f"missing key: {k}") for k in STYLE_KEYS]
    out += [F.when(text == "", "empty style_prompt"), F.when(F.length(text) < SHORTEST, F.concat(F.lit("style_prompt is short: "), F.length(text))), F.when(F.length(text) > LONGEST, F.concat(F.lit("style_prompt is long: "), F.length(text)))]
    out += [F.when(~F.contains(low, F.lit(duty)), f"style_prompt lacks: {duty}") for duty, _ in DUTIES]
    silent = (abbreviation_rate >= 0.4) & ~F.contains(low, F.lit("abbreviation")) & ~F.contains(low, F.lit("shorthand"))
    out += [F.when(silent, "style_prompt says nothing on abbreviations"), F.when(~F.contains(F.coalesce(stated, F.lit("")), professor), "another professor")]
    return F.array_compact(F.array(*out))


def style_prompt(professor: Column, opening: Column) -> Column:
    """A style prompt that needs no model; our own wording."""
    start = F.when(F.coalesce(opening, F.lit("")) != "", F.concat(F.lit("- Begin with this line, which is layout and no fact: "), opening, F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("Target style: notes of "), professor,
        F.lit("\n\nForm:\n- Short fragments as in the reference notes, not prose; same order of lines, same abbreviations and shorthand.\n"), start,
        F.lit("- About as long as the median reference.\n\nContent:\n"
              "1. Main or suspected diagnosis, or the reason of the visit.\n2. Main operation with its date if the facts have it.\n"
              "3. Pathology or treatment where this professor writes it.\n4. Status and next step in a few words.\n\nRules:\n"),
        F.lit("\n".join(line for _, line in DUTIES)),
        F.lit("\n- Leave out technique, anaesthesia, blood loss, drains, closure, routine negatives and the course until discharge.\n- Do not spell out abbreviations that the references use."),
    )


def repaired_style(prompt: Column, professor: Column, opening: Column, abbreviation_rate: Column) -> Column:
    """The prompt, or the one that needs no model if empty, with the rules that it lacks after it."""
    text = sanitize_style(prompt)
    text = F.when(text == "", style_prompt(professor, opening)).otherwise(text)
    low = F.lower(text)
    opening = F.coalesce(opening, F.lit(""))
    added = [F.when((opening != "") & ~F.contains(text, opening), F.concat(F.lit("- Begin with this line, which is layout and no fact: "), opening))]
    added += [F.when(~F.contains(low, F.lit(duty)), line) for duty, line in DUTIES]
    added.append(F.when((abbreviation_rate >= 0.4) & ~F.contains(low, F.lit("abbreviation")) & ~F.contains(low, F.lit("shorthand")), "- Keep abbreviations and shorthand as in the references."))
    more = F.array_compact(F.array(*added))
    return F.when(F.size(more) > 0, F.concat(text, F.lit("\n\nRules on safety and content:\n"), F.array_join(more, "\n"))).otherwise(text)
