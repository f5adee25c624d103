"""Reading of schedules: hardware cells, accessory lines and evidence on pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# How a manufacturer is written in a schedule, and its name.
MANUFACTURERS = {
    "HAGER": "Hager", "NGP": "NGP", "NATIONAL GUARD": "National Guard", "PEMKO": "Pemko", "ROCKWOOD": "Rockwood", "IVES": "IVES",
    "FALCON": "Falcon", "SCHLAGE": "Schlage", "VON DUPRIN": "Von Duprin", "LCN": "LCN", "ZERO": "Zero", "ADAMS RITE": "Adams Rite",
    "ROTON": "Roton", "CODE LOCKS": "Code Locks", "EDWARDS": "Edwards", "BEA": "BEA", "BEA GROUP": "BEA", "HORTON": "Horton",
    "GLYNN JOHNSON": "Glynn Johnson", "GLY": "Glynn Johnson", "CRL": "CRL", "DON JO": "Don-Jo", "MICOM": "Micom", "CAL ROYAL": "Cal-Royal",
    "ALARM LOCK": "Alarm Lock", "TRIMCO": "Trimco", "BOBRICK": "Bobrick", "ASI": "ASI", "BRADLEY": "Bradley", "GAMCO": "Gamco",
    "NUDO": "Nudo", "WORLD DRYER": "World Dryer", "MARLITE": "Marlite", "SARGENT": "Sargent", "CORBIN": "Corbin", "YALE": "Yale",
    "BEST": "Best", "STANLEY": "Stanley", "MCKINNEY": "McKinney", "TUBELITE": "Tubelite",
}
# Of these, those that supply accessories.
ACCESSORY_MAKERS = ["BOBRICK", "ASI", "BRADLEY", "GAMCO", "NUDO", "WORLD DRYER"]
# Fixed patterns: a finish, a supplier, a quantity, a unit and a measurement in a cell.
FINISH = r"(?i)^(?:(?:US\s?\d{1,2}[A-Z]?|\d{3}|\d{2}[A-Z])(?:\s*/\s*(?:US\s?\d{1,2}[A-Z]?|\d{3}|\d{2}[A-Z]))?|MILL?|ML|CL|CLR|ALUMINUM|ALUM\.?|BRASS|WHITE|DBRZ|PRIME\s+COAT(?:\s+NGP)?)$"
SUPPLIER = r"^(LL|GC|OWNER|TENANT|WIB)$"
QUANTITY = r"^\s*(\d+(?:\s+\d+/\d+)?|\d+/\d+)\s*"
UNIT = r"(?i)^(.*?)\b(EA|PR|PAIR|SET)\.?(.*)$"
MEASUREMENT = r"""^[\d\s/\-x×."']+$"""
EDGES = ",;:()\"'"
# Fixed patterns: accessories by the words of a line, the more telling ones first; a model and a count.
ACCESSORIES = {
    "toilet_tissue_dispenser": r"\b(?:TOILET\s+(?:PAPER|TISSUE)|JUMBO\s+ROLL)\b.*DISPENSER|\bTISSUE\s+DISPENSER\b",
    "paper_towel_dispenser": r"\b(?:PAPER\s+TOWEL|TOWEL)\s+DISPENSER\b",
    "soap_dispenser": r"\bSOAP\s+DISPENSER\b",
    "hand_dryer": r"\bHAND\s+DRYER\b",
    "grab_bar": r"\bGRAB\s+BARS?\b",
    "mirror": r"\bMIRROR\b",
    "coat_hook": r"\b(?:COAT\s+|ROBE\s+)?HOOKS?\b(?!\s*-?\s*UPS?\b)",
    "napkin_disposal": r"\bNAPKIN\s+(?:DISPOSAL|RECEPTACLE)\b",
    "seat_cover_dispenser": r"\bSEAT\s+COVER\b",
    "baby_change_station": r"\b(?:BABY\s+CHANG|DIAPER)\w*\b",
    "waste_receptacle": r"\b(?:WASTE|TRASH)\s+RECEPTACLE\b",
    "shelf": r"\bSHELF\b",
    "toilet_partition": r"\b(?:TOILET\s+)?(?:PARTITION|COMPARTMENT)S?\b",
    "robe_hook": r"\bROBE\s+HOOK\b",
}
MODEL = r"\b([A-Z]{0,3}-?\d[\dA-Z./x-]{2,})\b"
MODEL_WORD = r"(?i)^\s*(?:MODEL|MODEL\s+NO\.?|NO\.?|#)\s*"
COUNT = r"^\s*(\d{1,3})\s*(?:EA\.?|PR\.?)?\b"
PANEL = r"(?i)\bFRP\b|FIBERGLASS\s+REINFORCED\s+POLYESTER"
PANEL_KINDS = {"textured": r"(?i)\bTEXTURED\b", "non_tile": r"(?i)\bNON[\s-]?TILE\b", "embossed": r"(?i)\bEMBOSSED\b"}
NOT_MEASURED = ["perimeter_lf_not_measured", "wall_height_ft_not_measured", "inside_corners_not_measured", "outside_corners_not_measured"]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _first(cells: Column, holds) -> Column:
    """Index (from 0) of the first cell that holds, else null."""
    return F.get(F.filter(F.transform(cells, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull()), F.lit(0))


def _at(i: Column, *taken: Column) -> Column:
    return F.exists(F.array(*taken), lambda t: t.eqNullSafe(i) & i.isNotNull())


def hardware_items(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Adds qty, unit, description, part, finish, manufacturer, supplied_by, raw_row and flags, read from the cells of a schedule row.

    The manufacturer's cell is the anchor: the two cells left of it are the finish and the part; a cell there is a finish by its pattern only
    while none is known. What is left is prose, which may start with a quantity and hold a unit, and in which the first word that looks
    like a part number is one if there is no other. Nothing is guessed: what is missing is null and flagged.
    Null and empty cells count for nothing; a null or empty row has every flag.
    """
    names = F.create_map(*[F.lit(x) for pair in MANUFACTURERS.items() for x in pair])
    finish = lambda x: F.upper(x).rlike(FINISH)
    word = lambda x: F.btrim(x, F.lit(EDGES))
    head = lambda x: word(F.substring_index(x, " ", 1))
    partlike = lambda x: F.substring_index(x, " ", 1).rlike(r"\d") & (F.length(head(x)) >= 2)
    spoken = lambda x: (F.length(x) >= 2) & x.rlike(r"\d") & (x.rlike(r"^\d+$") | ~x.rlike(MEASUREMENT)) & ~finish(x)

    t = F.col("_texts")
    out = rows.withColumn("_texts", F.transform(F.coalesce(cells, F.array().cast("array<string>")), squeezed))
    out = out.withColumn("raw_row", F.array_join(F.filter(t, lambda x: x != ""), " | "))
    out = out.withColumn("_by", _first(t, lambda x, i: F.upper(x).rlike(SUPPLIER)))
    out = out.withColumn("_maker", _first(t, lambda x, i: F.map_contains_key(names, F.upper(x))))
    out = out.withColumn("supplied_by", F.upper(F.get(t, "_by"))).withColumn("manufacturer", F.try_element_at(names, F.upper(F.get(t, "_maker"))))
    near = [F.when(~_at(F.col("_maker") - n, F.col("_by")), F.nullif(F.get(t, F.col("_maker") - n), F.lit(""))) for n in (1, 2)]
    out = out.withColumn("_one", near[0]).withColumn("_two", near[1])
    one, two = F.col("_one"), F.col("_two")
    out = out.withColumn("_finish", F.when(finish(one), F.col("_maker") - 1).when(finish(two), F.col("_maker") - 2))
    left_over = ~F.coalesce(F.col("_finish") == F.col("_maker") - 2, F.lit(False))
    out = out.withColumn("_part", F.when(~finish(one) & partlike(one), F.col("_maker") - 1).when(left_over & partlike(two), F.col("_maker") - 2))
    out = out.withColumn("finish", F.get(t, "_finish")).withColumn("part", head(F.get(t, "_part")))
    rest = F.nullif(F.trim(F.regexp_replace(F.get(t, "_part"), r"^\S+", "")), F.lit(""))

    taken = [F.col(c) for c in ("_by", "_maker", "_finish", "_part")]
    out = out.withColumn("_prose", F.filter(F.filter(F.transform(t, lambda x, i: F.when(~_at(i, *taken), x)), lambda x: x.isNotNull()), lambda x: x != ""))
    out = out.withColumn("_n", _first(F.col("_prose"), lambda x, i: x.rlike(QUANTITY)))
    out = out.withColumn("qty", F.regexp_extract(F.get("_prose", "_n"), QUANTITY, 1))
    out = out.withColumn("_prose", F.transform("_prose", lambda x, i: F.when(i.eqNullSafe(F.col("_n")), F.trim(F.regexp_replace(x, QUANTITY, ""))).otherwise(x)))
    out = out.withColumn("_n", _first(F.col("_prose"), lambda x, i: x.rlike(UNIT)))
    out = out.withColumn("unit", F.concat(F.upper(F.regexp_extract(F.get("_prose", "_n"), UNIT, 2)), F.lit(".")))
    out = out.withColumn("_prose", F.transform("_prose", lambda x, i: F.when(i.eqNullSafe(F.col("_n")), F.trim(F.regexp_replace(x, UNIT, "$1 $3"))).otherwise(x)))
    out = out.withColumn("_prose", F.filter("_prose", lambda x: x != ""))
    said = F.array_join("_prose", " ")
    words = F.filter(F.transform(F.split(said, " +"), word), spoken)
    out = out.withColumn("part", F.coalesce("part", F.get(words, F.lit(0))))
    out = out.withColumn("description", F.nullif(F.concat_ws(" ", F.nullif(said, F.lit("")), rest), F.lit("")))
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c}_missing")) for c in ("part", "manufacturer", "qty")]
    out = out.withColumn("flags", F.array_compact(F.array(*missing)))
    return out.drop("_texts", "_by", "_maker", "_one", "_two", "_finish", "_part", "_prose", "_n")


def accessory_types(line: Column) -> Column:
    """Every accessory that a line names, the more telling first."""
    return F.array_compact(F.array(*[F.when(line.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in ACCESSORIES.items()]))


def accessory_maker(line: Column) -> Column:
    """The first accessory maker that a line names, as it is written there in capitals; else null."""
    upper = F.upper(line)
    return F.coalesce(*[F.when(upper.rlike(rf"\b{name}\b"), F.lit(name)) for name in ACCESSORY_MAKERS])


def model_after(line: Column, written: Column) -> Column:
    """The model number after a maker's name (anywhere if the name is not there), null without one or without a maker."""
    at = F.instr(F.upper(line), written)
    tail = F.when(at > 0, F.substr(line, at + F.length(written), F.length(line))).otherwise(F.when(written.isNotNull(), line))
    return F.nullif(F.btrim(F.regexp_extract(F.regexp_replace(tail, MODEL_WORD, " "), MODEL, 1), F.lit(".,;:")), F.lit(""))


def accessory_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows whose line names an accessory, with product_type, alternate, manufacturer, specified_model, qty, flags and confidence.

    A quantity is never assumed. Lines that are null or name none go.
    """
    names = F.create_map(*[F.lit(x) for name in ACCESSORY_MAKERS for x in (name, MANUFACTURERS[name])])
    out = lines.withColumn("notes", squeezed(F.col(line))).withColumn("_types", accessory_types(F.col("notes"))).where(F.size("_types") > 0)
    out = out.withColumn("_maker", accessory_maker(F.col("notes")))
    out = out.withColumn("product_type", F.get("_types", F.lit(0)))
    out = out.withColumn("alternate", F.nullif(F.array_join(F.expr("slice(_types, 2, size(_types))"), "/"), F.lit("")))
    out = out.withColumn("manufacturer", F.try_element_at(names, F.col("_maker"))).withColumn("specified_model", model_after(F.col("notes"), F.col("_maker")))
    out = out.withColumn("qty", F.nullif(F.regexp_extract("notes", COUNT, 1), F.lit("")).cast("double"))
    flags = {
        "product_type_ambiguous": F.size("_types") > 1,
        "manufacturer_missing": F.col("manufacturer").isNull(),
        "specified_model_missing": F.col("specified_model").isNull(),
        "qty_not_stated": F.col("qty").isNull(),
    }
    out = out.withColumn("flags", F.array_compact(F.array(*[F.when(on, F.lit(flag)) for flag, on in flags.items()])))
    confidence = F.round(F.greatest(F.lit(0.3), 1 - 0.15 * F.size("flags")), 2)
    return out.withColumn("confidence", confidence).withColumn("notes", F.left("notes", F.lit(300))).drop("_types", "_maker")


def accessory_schedule(found: DataFrame, group: str, page: str, order: str) -> DataFrame:
    """Of accessory_lines those to report, with kind: item or mention.

    A line with manufacturer and model is an item, the first of each accessory, manufacturer and model of a group counts; any other is a
    mention, the first of each accessory and page.
    """
    whole = F.col("manufacturer").isNotNull() & F.col("specified_model").isNotNull()
    rows = found.withColumn("kind", F.when(whole, "item").otherwise("mention"))
    what = [F.when(whole, F.col(c)) for c in ("manufacturer", "specified_model")]
    key = W.partitionBy(group, "product_type", "kind", *what, F.when(~whole, F.col(page))).orderBy(page, order)
    return rows.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def panel_pages(pages: DataFrame, text: str) -> DataFrame:
    """The pages that name FRP panels, with excerpt (the first such line, else empty), kinds, and the maker that such a line names."""
    rows = pages.where(F.col(text).rlike(PANEL))
    rows = rows.withColumn("_lines", F.filter(F.split(F.col(text), r"\r\n|\n|\r"), lambda x: x.rlike(PANEL)))
    makers = F.filter(F.transform("_lines", accessory_maker), lambda x: x.isNotNull())
    kinds = F.array_compact(F.array(*[F.when(F.col(text).rlike(pattern), F.lit(kind)) for kind, pattern in PANEL_KINDS.items()]))
    excerpt = F.left(squeezed(F.get("_lines", F.lit(0))), F.lit(200))
    return rows.withColumn("excerpt", excerpt).withColumn("kinds", kinds).withColumn("maker", F.get(makers, F.lit(0))).drop("_lines")


def panel_findings(pages: DataFrame, group: str, page: str, text: str) -> DataFrame:
    """One row a group: whether its pages name FRP panels, on how many, of which kinds and by whom.

    A manufacturer counts only where its line names the panels too, that of the first such page and line. Geometry is never read: its fields
    are flagged as not measured. Groups whose pages have no text have a row too.
    """
    named = panel_pages(pages, text).groupBy(group).agg(
        F.count("*").alias("n_pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("_kinds"),
        F.min_by("maker", F.when(F.col("maker").isNotNull(), F.col(page))).alias("_maker"),
    )
    names = F.create_map(*[F.lit(x) for name in ACCESSORY_MAKERS for x in (name, MANUFACTURERS[name])])
    out = pages.select(group).distinct().join(named, group, "left")
    seen = F.col("n_pages").isNotNull()
    unknown = F.when(F.col("_maker").isNull(), F.array(F.lit("manufacturer_missing"))).otherwise(F.array().cast("array<string>"))
    flags = F.when(seen, F.concat(F.array(*[F.lit(x) for x in NOT_MEASURED]), unknown)).otherwise(F.array(F.lit("no_frp_on_the_sheets_tagged_for_it")))
    return out.select(
        group, seen.alias("frp_in_scope"), F.when(seen, "NOT_MEASURED").otherwise("NOT_FOUND").alias("status"),
        F.when(seen, F.coalesce(F.nullif(F.array_join("_kinds", "/"), F.lit("")), F.lit("FRP wall panel"))).alias("product_type"),
        F.try_element_at(names, F.col("_maker")).alias("manufacturer"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), flags.alias("flags"),
    )
