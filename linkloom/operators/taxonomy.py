"""The two-level taxonomy: seed, listings and edits. ``categories`` is a small dictionary table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import strip
from linkloom.operators.stats import category_counts
from linkloom.operators.status import rewrite
from linkloom.operators.worklists import has_status
from linkloom.scale import number_rows
from linkloom.schema import DONE

# Sections and their categories, in order.
SECTIONS = (
    (
        "IT и разработка",
        (
            "Искусственный интеллект",
            "Программирование",
            "Repository",
            "Веб-разработка",
            "Разработка приложений",
            "DevOps и инфраструктура",
            "Данные и аналитика",
            "Кибербезопасность",
            "Сети",
            "Тестирование и QA",
            "Оборудование",
            "Операционные системы",
            "SaaS",
        ),
    ),
    (
        "Управление и бизнес",
        (
            "Управление проектами",
            "Карьера",
            "Бизнес",
            "Стартапы",
            "Финансы",
            "Трейдинг",
        ),
    ),
    (
        "Наука и образование",
        (
            "Образование",
            "Наука",
            "История",
        ),
    ),
    (
        "Дизайн и медиа",
        (
            "Дизайн",
            "Игры",
            "Медиа и контент",
            "Литература",
            "Музыка",
            "Книги",
        ),
    ),
    (
        "Прочее",
        (
            "Автоматизация",
            "Автомобили и транспорт",
            "DIY",
            "Еда и напитки",
            "Здоровье и спорт",
            "Политика и право",
            "Интернет-магазин",
            "Одежда",
            "Снаряжение",
            "Аксессуары",
            "Для дома",
        ),
    ),
)

# Domains with a known section, category or both.
RULES = (
    ("habr.com", "IT и разработка", None),
    ("flibusta.is", None, "Книги"),
    ("youtube.com", None, "Медиа и контент"),
    ("youtu.be", None, "Медиа и контент"),
    ("rozetka.com.ua", None, "Интернет-магазин"),
    ("amazon.com", None, "Интернет-магазин"),
    ("github.com", "IT и разработка", "Repository"),
    ("gitlab.com", "IT и разработка", "Repository"),
    ("stackoverflow.com", "IT и разработка", "Программирование"),
)


def default_sections(spark: SparkSession) -> DataFrame:
    """The built-in taxonomy as (position, section, names)."""
    rows = [(i, section, list(names)) for i, (section, names) in enumerate(SECTIONS)]
    return spark.createDataFrame(rows, "position int, section string, names array<string>")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "domain string, section string, category string")


def seed(sections: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Category rows for an ordered list of sections, only if there are none yet.

    The running ``sort_order`` also counts repeated names; the first of them is kept.
    """
    if existing is not None:
        sections = sections.filter(existing.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() == 0)
    entries = sections.select("section", "position", F.posexplode("names").alias("place", "name"))
    placed = number_rows(entries, ["position", "place"], "sort_order").withColumn("sort_order", F.col("sort_order") - 1)
    kept = placed.groupBy("name").agg(F.min("sort_order").alias("sort_order"), F.min_by("section", "sort_order").alias("section"))
    return number_rows(kept, ["sort_order"], "id").select("id", "name", "section", "sort_order")


def flat(categories: DataFrame) -> DataFrame:
    return categories.orderBy("sort_order", "id").select("id", "name", "section", "sort_order")


def sections(categories: DataFrame) -> DataFrame:
    """Sections in the order of their first category."""
    return (
        categories.groupBy("section")
        .agg(F.min("sort_order").alias("first_order"), F.min("id").alias("first_id"))
        .orderBy("first_order", "first_id")
    )


def section_lists(categories: DataFrame) -> DataFrame:
    """Sections with their ordered category names."""
    ordered = F.array_sort(F.collect_list(F.struct("sort_order", "id", "name")))
    return (
        categories.groupBy("section")
        .agg(
            F.min(F.struct("sort_order", "id")).alias("_first"),
            F.transform(ordered, lambda c: c["name"]).alias("names"),
        )
        .orderBy("_first")
        .select("section", "names", F.col("_first.sort_order").alias("first_order"))
    )


def with_counts(categories: DataFrame, urls: DataFrame) -> DataFrame:
    """Categories with the number of done links, zero included. Links are counted before the join."""
    used = urls.filter(has_status(DONE)).groupBy(F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        categories.join(used, "name", "left")
        .select("id", "name", "section", "sort_order", F.coalesce("_n", F.lit(0)).alias("url_count"))
        .orderBy("sort_order", "id")
    )


def grouped_with_counts(categories: DataFrame, urls: DataFrame) -> DataFrame:
    """Sections with their categories and counts, sections in first-appearance order."""
    counted = with_counts(categories, urls)
    packed = F.array_sort(F.collect_list(F.struct("sort_order", "id", "name", "url_count")))
    return (
        counted.groupBy("section")
        .agg(F.min(F.struct("sort_order", "id")).alias("_first"), packed.alias("cats"))
        .orderBy("_first")
        .select("section", "cats", F.col("_first.sort_order").alias("first_order"))
    )


def create(categories: DataFrame, name: str, section: str, high_water: int | None = None) -> DataFrame:
    """Add a category at the end of its section; an empty or existing name adds nothing."""
    spark = categories.sparkSession
    top = categories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar() if high_water is None else F.lit(high_water)
    last = categories.filter(F.col("section") == section).agg(F.coalesce(F.max("sort_order"), F.lit(0)).alias("last")).scalar()
    one = spark.range(1).select(strip(F.lit(name)).alias("name"), F.lit(section).alias("section"))
    fresh = one.filter(F.col("name") != "").join(categories.select("name"), "name", "left_anti")
    added = fresh.select((top + 1).alias("id"), "name", "section", (last + 1).alias("sort_order"))
    return categories.unionByName(added)


def _can_rename(categories: DataFrame, old: str, new: str):
    """True when ``new`` is non-empty, different and free. One dictionary count."""
    if not new or old == new:
        return F.lit(False)
    taken = categories.filter(F.col("name") == new).agg(F.count(F.lit(1)).alias("n")).scalar()
    return taken == 0


def rename(categories: DataFrame, urls: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Rename a category and rewrite its links, whatever their status. Returns both tables."""
    new = new.strip()
    allowed = _can_rename(categories, old, new)
    return (
        rewrite(categories, (F.col("name") == old) & allowed, {"name": new}),
        rewrite(urls, (F.col("category") == old) & allowed, {"category": new}),
    )


def move(categories: DataFrame, name: str, section: str) -> DataFrame:
    return rewrite(categories, F.col("name") == name, {"section": section})


def delete(
    categories: DataFrame, urls: DataFrame, name: str, reassign_to: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete a category. Its links move to ``reassign_to`` or lose category and manual mark.

    Returns both tables and a one-row count of the done links that had it.
    """
    values = {"category": reassign_to} if reassign_to else {"category": None, "manual_override": 0}
    count = urls.filter((F.col("category") == name) & has_status(DONE)).agg(F.count(F.lit(1)).alias("url_count"))
    return categories.filter(F.col("name") != name), rewrite(urls, F.col("category") == name, values), count


def coverage(categories: DataFrame, urls: DataFrame) -> DataFrame:
    """Counts for every taxonomy name (0 if unused) and for categories outside the taxonomy."""
    listed = categories.select(F.col("name").alias("category"), "section", F.lit(True).alias("_listed"))
    return listed.join(category_counts(urls), "category", "full_outer").select(
        "category",
        "section",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.col("_listed").isNotNull().alias("in_taxonomy"),
    )
