"""Text profiles of sale listings: claims of structured fields and of the text, conflicts between them, title rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import scalars as S
from cadastra.functions.text import family_conflict

VERSION = "cadastra-claims-1"

#: What structured fields claim.
STRUCTURED = {
    "rent_renovation": {
        "черновая отделка": "finish_rough",
        "требует ремонта": "finish_needs_repair",
        "свежий ремонт": "finish_fresh",
        "не новый, но аккуратный ремонт": "finish_lived_in",
        "свободная планировка": "free_layout",
    },
    "furniture": {
        "полностью": "furniture_full",
        "частично": "furniture_partial",
        "без мебели": "furniture_none",
    },
}

#: Patterns of claims in texts.
CLAIMS = {
    "finish_rough": r"\b(?:в\s+)?чернов(?:ой|ая|ую|ом)\s+(?:отделк[еауи]|вариант[еа])\b",
    "finish_pre_finish": r"\bпредчистов(?:ая|ой|ую)\s+отделк[а-я]*\b",
    "finish_needs_repair": r"\b(?:требует|нужен|под)\s+(?:(?:капитальн[а-я]*|косметическ[а-я]*)\s+)?ремонт[а-я]*\b|\bбез\s+ремонта\b",
    "finish_fresh": r"\b(?:свежий|новый)\s+ремонт\b|\bремонт\s+(?:свежий|новый)\b",
    "finish_lived_in": r"\b(?:ремонт\s+не\s+новый|старый\s+ремонт)\b",
    "finish_unfinished": r"\b(?:ремонт\s+не\s+закончен|незаконченный\s+ремонт|ремонт\s+в\s+процессе)\b",
    "finish_designer_claim": r"\bдизайнерск(?:ий|им|ого|ому)\s+ремонт[а-я]*\b",
    "move_in_ready_claim": r"\bзаезжай\s+и\s+живи\b|\bготова\s+к\s+проживанию\b",
    "furniture_full": r"\b(?:вся|полностью\s+с)\s+мебель(?:ю|\s+оста[её]тся)\b|\bмебель\s+и\s+техника\s+оста[её]тся\b",
    "furniture_none": r"\bбез\s+мебели\b|\bмебель\s+не\s+оста[её]тся\b",
    "tenant_occupied": r"\b(?:живут|проживают)\s+(?:арендатор[а-я]*|квартирант[а-я]*)\b|\bквартира\s+с\s+(?:арендатор[а-я]*|квартирант[а-я]*)\b|\bпрода[её]тся\s+с\s+действующ(?:им|ими)\s+арендатор[а-я]*\b",
    "vacant_claim": r"\bквартира\s+(?:свободна|пустует)\b|\bникто\s+не\s+проживает\b",
    "under_construction": r"\bстроящ(?:ийся|емся|егося)\s+дом[а-я]*\b|\bдом\s+ещ[её]\s+строится\b",
    "keys_received_claim": r"\bключи\s+(?:получены|на\s+руках)\b",
    "commissioned_claim": r"\bдом\s+сдан\s+в\s+эксплуатацию\b|\bакт\s+ввода\s+получен\b",
    "assignment_sale": r"\b(?:по\s+)?переуступк[еаиу]\b|\bдоговор\s+цессии\b",
    "cash_only": r"\bтолько\s+(?:за\s+)?наличн(?:ые|ый\s+расч[её]т)\b|\bипотек[а-я]*\s+не\s+(?:проходит|рассматрива[а-я]*)\b",
    "installment_offer": r"\bрассрочк[а-я]*\s+(?:возможна|есть|от\s+застройщика)\b|\bвозможна\s+рассрочка\b",
    "mortgage_possible_claim": r"\b(?:ипотек[а-я]*\s+(?:проходит|возможна|подходит)|подходит\s+под\s+ипотеку)\b",
    "mortgage_encumbered_claim": r"\b(?:квартира|объект)\s+(?:в\s+)?залоге\s+(?:у\s+)?банк[а-я]*\b|\bобременени[еям]\s+(?:в\s+)?виде\s+ипотек[а-я]*\b",
    "exchange_offer": r"\b(?:обмен\s+с\s+доплатой|рассмотр[а-я]*\s+обмен|возможен\s+обмен)\b",
    "auction_sale": r"\b(?:продажа\s+с\s+торгов|аукционн(?:ая|ые)\s+продаж[а-я]*|реализация\s+через\s+аукцион)\b",
    "legal_issue_claim": r"\b(?:квартира\s+под\s+арестом|документы\s+не\s+в\s+порядке|перепланировка\s+не\s+узаконена)\b",
    "partial_price_claim": r"\b(?:указан[а-я]*\s+первоначальн[а-я]*\s+взнос|(?:указана\s+цена|цена\s+в\s+объявлении)\s+за\s+(?:кв\.?\s*м|м²|долю)|полная\s+стоимость\s+по\s+запросу)\b",
    "water_damage_claim": r"\b(?:после\s+(?:затопления|потопа)|квартиру\s+затопило)\b",
    "fire_damage_claim": r"\b(?:квартира\s+после\s+пожара|после\s+пожара\s+в\s+квартире)\b",
    "demolition_claim": r"\b(?:дом\s+под\s+снос|дом\s+признан\s+аварийным)\b",
    "rental_income_claim": r"\b(?:готовый\s+арендный\s+бизнес|квартира\s+приносит\s+арендный\s+доход)\b",
    "urgent_claim": r"\bсрочн(?:о|ая|ый)\s+прода[а-я]*\b|\bсрочная\s+продажа\b",
}

#: What negates a claim right before it, and what shows that fresh work is wanted, not offered.
NEGATION = r"\b(?:не|нет|без|после)\s+(?:в\s+)?$"
WANTED_BEFORE, WANTED_AFTER = r"\b(?:нужен|требуется)\s+$", r"^\s+не\s+(?:нужен|требуется)\b"
FINISH = ["finish_rough", "finish_pre_finish", "finish_needs_repair", "finish_fresh", "finish_lived_in"]

#: Titles that decide alone, in this order.
TITLE_RULES = [
    ("partial_property", r"\bдол(?:я|ю|и)\s+(?:в\s+)?квартир"),
    ("partial_property", r"\bкомнат[ау]\s+(?:в\s+)?(?:\d+[\s-]*)?комнатн(?:ой|ую)\s+квартир"),
    ("partial_property", r"\bчаст[ьи]\s+квартир"),
    ("not_apartment", r"^(?:(?:срочно\s+)?(?:продам|прода[её]тся)\s+)?(?:офис|магазин|склад|гараж|паркинг|кладов(?:ая|ку))\b"),
    ("not_apartment", r"^(?:(?:срочно\s+)?(?:продам|прода[её]тся)\s+)?нежил(?:ое|ого)\s+помещен"),
]


def insensitive(pattern: str) -> str:
    """The pattern in any case and with Unicode classes, as Java writes it."""
    return f"(?iU){pattern}"


def title_rule(title: Column) -> Column:
    """Reason code of the first title rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    trimmed = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", "")
    for code, pattern in reversed(TITLE_RULES):
        found = F.when(trimmed.rlike(insensitive(pattern)), F.lit(code)).otherwise(found)
    return found


def _claim(text: Column, code: str, pattern: str) -> Column:
    """The first match as a signal, unless what stands around it takes it back. Later matches are not looked at."""
    parts = lambda group: F.regexp_extract(text, f"(?iUs)^(.*?)({pattern})(.*)$", group)
    before = F.right(parts(1), F.lit(20))
    refused = before.rlike(insensitive(NEGATION))
    if code == "finish_fresh":
        refused = refused | before.rlike(insensitive(WANTED_BEFORE)) | parts(3).rlike(insensitive(WANTED_AFTER))
    signal = F.struct(F.lit(code).alias("code"), F.lit("text").alias("source"), F.substring(parts(2), 1, 100).alias("evidence"))
    return F.when(text.rlike(insensitive(pattern)) & ~refused, signal)


def signals(text: Column, structured: dict[str, Column], patterns: dict[str, str] | None = None) -> Column:
    """Sorted structs code, source, evidence of what the fields and the text claim."""
    plain = lambda v: F.regexp_replace(F.lower(F.trim(F.coalesce(v, F.lit("")))), "ё", "е")
    said = [F.when(plain(v) == phrase.replace("ё", "е"), F.struct(F.lit(code).alias("code"), F.lit(field).alias("source"), v.alias("evidence"))) for field, v in structured.items() for phrase, code in STRUCTURED[field].items()]
    found = [_claim(F.coalesce(text, F.lit("")), code, pattern) for code, pattern in (CLAIMS if patterns is None else patterns).items()]
    return F.array_sort(F.array_compact(F.array(*said, *found)))


def conflicts(codes: Column) -> Column:
    """finish for several states of finish, furniture for full and none."""
    finish = F.size(family_conflict(codes, FINISH)) > 0
    furniture = F.array_contains(codes, "furniture_full") & F.array_contains(codes, "furniture_none")
    return F.array_compact(F.array(F.when(finish, F.lit("finish")), F.when(furniture, F.lit("furniture"))))


def profile(rows: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """id, profile_hash, version, signals, conflicts of rows (id, title, full_description, rent_renovation, furniture)."""
    fields = [F.col(c) for c in ("title", "full_description", "rent_renovation", "furniture")]
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("full_description", F.lit("")))
    found = rows.select("id", S.typed_hash(*fields, digits=16).alias("profile_hash"), F.lit(VERSION).alias("version"), signals(text, {f: F.col(f) for f in STRUCTURED}, patterns).alias("signals"))
    return found.withColumn("conflicts", conflicts(F.transform("signals", lambda s: s["code"])))


def updated(profiles: DataFrame, rows: DataFrame, patterns: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles of all rows, those computed anew): only rows of another hash or version are read by the patterns; gone rows leave."""
    fields = [F.col(c) for c in ("title", "full_description", "rent_renovation", "furniture")]
    now = rows.withColumn("__hash", S.typed_hash(*fields, digits=16))
    same = now.join(profiles.filter(F.col("version") == VERSION), "id").filter("__hash = profile_hash").select("id", "profile_hash", "version", "signals", "conflicts")
    fresh = profile(now.join(same.select("id"), "id", "left_anti"), patterns)
    return same.unionByName(fresh), fresh
