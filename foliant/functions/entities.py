"""People, terms and acronyms: which matches of a shape are meant, by stop lists and by what stands behind them."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as tx

# What looks like a name, an acronym or a person and isn't.
NAME_STOP = (
    "Active Inference", "Artificial Intelligence", "Artificial General Intelligence", "Chapter One", "Chapter Two", "Chapter Three", "Deep Learning", "Foundation Model",
    "Free Energy Principle", "Machine Learning", "New York", "Open Access", "Scaling Laws", "The Singularity Is Near", "Thousand Brains Theory", "United Kingdom",
    "United Nations", "United States", "Whole Brain Architecture",
)
ACRONYM_STOP = "AND ISBN ISSN HTTP HTTPS LAWS PDF THE URL WWW".split()
JAPANESE_NAME_STOP = "人工知能 本書 問題 研究 社会 科学 知能 理論 人間".split()
NONPERSON_SUFFIXES = (
    "アーキテクチャ アプローチ アライメント アルゴリズム エージェント グループ コスト コンピュータ システム シナリオ スケーリング データ ネットワーク タスク トークン "
    "トランスフォーマー ハードウェア フレームワーク プラットフォーム プロセス ベンチマーク モデル リスク オートポイエーシス エナクティビズム クオリア シミュレーション "
    "スタートアップ センサー ダイナミズム パラダイム プルラリティ マップ ループ 問題 理論 社会 知能 研究 科学 構造 制度 設計 命題 前提 原理 能力 技術 分析 結論 価値 根拠"
).split()
VERTICAL_NONPERSON = "名誉 特任 専任 主任 准 客員 非常勤".split()
VERTICAL_NONPERSON_SUFFIXES = "大学 大学院 学部 学科 研究所 研究院 研究機関 委員会 協議会 財団 政府 特任 主任 専任".split()
# Verbs of attribution, marks of persons, what a person's name is followed by.
JAPANESE_ATTRIBUTION = (
    r"論じ(?:た|て|る)?|述べ(?:た|て|る)?|提唱(?:し|した|する)|指摘(?:し|した|する)|考案(?:し|した|する)|創始(?:し|した|する)|主張(?:し|した|する)|実証(?:し|した|する)|"
    r"受賞(?:し|した|する)|定義(?:し|した|する)|予測(?:し|した|する)|示(?:し|した|す)|唱え(?:た|て|る)?"
)
PERSON_MARK = r"(?:氏|博士|教授)"
HONORIFIC = r"(?:氏|博士|教授|によれば|によると)"
SUBJECT = r"(?:は|が|により|による)"
OWN_WORK = r"の(?:理論|法則|議論|分類|予測|立場|構想)"
DEFINED_TERM = r"(?:^|[。！？、「」])([ぁ-んァ-ヶー一-龠々A-Za-z][ぁ-んァ-ヶー一-龠々A-Za-z0-9・+／/_-]{1,39})(?=とは|と呼ば)"
VERTICAL_KATAKANA_NAME = r"([ァ-ヶー]{3,24}(?:・[ァ-ヶー]{2,24}){0,3})(?=氏|博士|教授|は|が|によ(?:り|る)|の)"
VERTICAL_KANJI_NAME = r"([一-龠々髙高]{2,5})(?=氏|博士|教授)"
LEXICAL = r"[ァ-ヶー一-龠々髙高A-Za-z0-9・+／/_-]+"


def _ends(c: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(c, F.lit(x)) for x in suffixes])


def acronyms(text: Column) -> Column:
    """Acronyms in order: no stop words, numbers in Roman letters, abbreviations with dots or long words in capitals."""
    found = F.regexp_extract_all(text, F.lit(tx.ACRONYM), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*ACRONYM_STOP) & ~F.contains(x, F.lit(".")) & ~x.rlike("^[IVXLCDM]+$") & ~(x.rlike("^[A-Za-z]+$") & (F.length(x) > 8)))


def no_acronym(label: str) -> bool:
    """Whether what has the shape of an acronym isn't one, as in ``acronyms``."""
    roman = not set(label) - set("IVXLCDM")
    return label in ACRONYM_STOP or "." in label or roman or label.isascii() and label.isalpha() and len(label) > 8


def english_names(text: Column) -> Column:
    """Runs of capitalised words in order, a stop phrase ahead of a name taken off (the longest), stop phrases left out."""
    longest = "|".join(rf"\Q{x}\E" for x in sorted(NAME_STOP, key=lambda x: (-len(x), x)))
    cut = F.transform(F.regexp_extract_all(text, F.lit(tx.PERSON), F.lit(1)), lambda x: F.regexp_replace(x, f"^(?:{longest}) ", ""))
    return F.filter(cut, lambda x: ~x.isin(*NAME_STOP))


def latin_person(after: Column, vertical: bool = False) -> Column:
    """Whether what follows a Latin name (compact) says that a person is meant: a mark and then a verb of attribution, or such a verb."""
    near = r"[^。！？]{0,36}" if vertical else r".{0,36}"
    return after.rlike(rf"^\s*(?:氏|博士|教授|によれば|によると|は|が|により|による){near}(?:{JAPANESE_ATTRIBUTION})") | after.rlike(rf"^\s*(?:{tx.ATTRIBUTION})")


def japanese_person(label: Column, after: Column, kanji: bool, vertical: bool = False) -> Column:
    """Whether a name in kanji or katakana stands for a person, by its form and what follows it (compact, 80 characters)."""
    wrong = label.isin(*JAPANESE_NAME_STOP) | _ends(label, NONPERSON_SUFFIXES)
    marked, honoured = after.rlike(f"^{PERSON_MARK}"), after.rlike(f"^{HONORIFIC}")
    if kanji:
        least = 2 if vertical else 3
        wrong = wrong | ~F.length(label).between(least, 5) | F.substring(label, 1, 1).isin(*"本各同前後上下大小新全第")
        if vertical:
            wrong = wrong | label.isin(*VERTICAL_NONPERSON) | _ends(label, VERTICAL_NONPERSON_SUFFIXES)
        return ~wrong & (marked if vertical else honoured)
    several = F.contains(label, F.lit("・"))
    wrong = wrong | ~several & ~F.length(label).between(3, 12)
    near = r"[^。！？]{0,20}" if vertical else ".{0,28}"
    said = honoured | after.rlike(f"^{SUBJECT}{near}(?:{JAPANESE_ATTRIBUTION})") | after.rlike(f"^{OWN_WORK}")
    return ~wrong & (F.when(several, said).otherwise(marked) if vertical else said)


def quoted_term_label(c: Column) -> Column:
    """Whether a quoted label of vertical print is a short term, not a sentence."""
    return F.length(c).between(2, 24) & ~c.rlike("[。！？]") & c.rlike(f"^{LEXICAL}(?:の{LEXICAL})?$")


def defined_term_label(c: Column) -> Column:
    """Whether an unquoted label of vertical print has the shape of a term."""
    return F.length(c).between(2, 24) & ~c.rlike("[ぁ-ゖ]") & c.rlike(f"^{LEXICAL}$")


def is_japanese(c: Column) -> Column:
    """Whether a single character is a Japanese one."""
    return c.rlike(r"^[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]$")


def is_kana(c: Column, hiragana: bool = False) -> Column:
    """Whether a single character is kana, or hiragana."""
    return c.rlike(r"^[\x{3040}-\x{309f}]$" if hiragana else r"^[\x{3040}-\x{30ff}]$")


def is_horizontal(c: Column) -> Column:
    """Whether a token of a vertical page is one set across: several ASCII characters with a letter among them."""
    return c.rlike(r"^(?=.*[A-Za-z])[\x{00}-\x{7f}]{2,}$")


def _horizontal(token: str) -> bool:
    return len(token) > 1 and token.isascii() and any(x.isalpha() for x in token)


@F.pandas_udf(T.StringType())
def joined_glyphs(values: pd.Series) -> pd.Series:
    """Pages with a glyph a line as running text: a line a page, compatibility forms normalised, blanks only between tokens set across."""

    def page(raw: str) -> str:
        tokens = [unicodedata.normalize("NFKC", x.strip()) for x in raw.splitlines() if x.strip()]
        pairs = zip(tokens, [*tokens[1:], ""], strict=True)
        return "".join(a + " " if _horizontal(a) and _horizontal(b) else a for a, b in pairs)

    return values.map(lambda x: "\n".join(filter(None, map(page, x.split("\f")))), na_action="ignore")


#: Whether a heading of plain text is one of a chapter or part (fixed value).
PLAIN_HEADING = r"(?i)^(?:chapter\s+\d+|part\s+\d+|第\s*[^\s]{1,8}\s*章)(?:\b|\s|[:：.-]|$)"


def bounded_pattern(term: Column) -> Column:
    """A pattern for a normalised term: as a word of its own where it is ASCII letters and digits, anywhere if not."""
    plain = term.rlike("^[a-z0-9]+$")
    return F.when(plain, F.concat(F.lit("(?<![a-z0-9])"), tx.quoted(term), F.lit("(?![a-z0-9])"))).otherwise(tx.quoted(term))


def bounded_positions(text: Column, term: Column) -> Column:
    """Starts of all non-overlapping occurrences of a term, as ``bounded_pattern`` finds them."""
    return tx.pattern_positions(text, bounded_pattern(term), F.length(term))

