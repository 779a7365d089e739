"""Product domains of free text: detection, related domains, and the fields that a domain's rules find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.urls import let

# Detectors, related domains and rules of each domain, in their natural order.
# A rule is (kind, field, what it looks for, more); the first rule that gives a field a value wins.
DETECT = {
    "keyboard": [r"\bkeyboard(s)?\b", r"\bmechanical keyboard\b", r"\bhall effect keyboard\b", r"\bgaming keyboard\b", r"\bbarebone keyboard\b"],
    "mouse": [r"\bmice\b", r"\bmouse\b", r"\bgaming mouse\b", r"\bwireless mouse\b"],
    "audio": [r"\biem\b", r"\bin-ear\b", r"\bearphone(s)?\b", r"\bheadphones?\b", r"\bheadset\b", r"\bspeakers?\b", r"\bsoundbar\b"],
    "display": [r"\bmonitor\b", r"\bdisplay\b", r"\btelevision\b", r"\btv\b"],
    "storage": [r"\bssd\b", r"\bhdd\b", r"\bsolid state\b", r"\bhard drive\b"],
    "camera": [r"\bcamera\b", r"\bwebcam\b", r"\bmirrorless\b", r"\bdslr\b"],
    "networking": [r"\brouter\b", r"\bswitch\b", r"\baccess point\b", r"\bnetwork adapter\b"],
    "mousepad": [r"\bmouse ?pad(s)?\b", r"\bdesk ?mat(s)?\b", r"\bmousemat(s)?\b"],
    "computer": [r"\blaptop\b", r"\bnotebook\b", r"\bdesktop\b", r"\bprebuilt\b", r"\bmini pc\b"],
}
RELATED = {"computer": ["display", "storage"]}
RULES = {
    "keyboard": [
        ("regex", "layout", r"(?:40|60|65|68|75|80|96|98|100)%|\bTKL\b|\b(?:RK61|G61|87|108)\b", "layout"),
        ("first_of", "keycap_profile", [("cherry", "Cherry"), ("pbt", "PBT"), ("abs", "ABS"), ("oem", "OEM"), ("mda", "MDA"), ("osa", "OSA"), ("asa", "ASA"), ("xda", "XDA"), ("sa", "SA")], None),
        ("first_of", "hotswap", [("hot-swap", "Yes"), ("hotswap", "Yes")], None),
        ("first_of", "assembly", [("barebone", "Barebone"), ("prebuilt", "Prebuilt"), ("assembled", "Prebuilt")], None),
        ("measurement", "weight", r"(?<!\d)(\d{1,4}(?:\.\d+)?)\s*(g|kg)\b", "weight_g"),
        ("measurement", "battery", r"(?<!\d)(\d{2,6})\s*mAh\b", "mAh"),
        ("all_of", "pins", [(r"\b3[- ]?pin\b", "3-pin"), (r"\b5[- ]?pin\b", "5-pin")], None),
        ("first_of", "knob_support", [("knob", "Yes"), ("rotary encoder", "Yes")], None),
        ("first_of", "mount_style", [("gasket", "Gasket"), ("top mount", "Top"), ("bottom mount", "Bottom"), ("plate", "Plate"), ("tray", "Tray"),
            ("sandwich", "Sandwich"), ("pcb mount", "PCB")], None),
        ("all_of", "case_material", [(rf"\b{m}\b", m.title()) for m in ("abs", "aluminum", "polycarbonate", "acrylic", "wood", "silicone", "steel", "copper")], None),
        ("measurement", "polling_rate", r"(?<!\d)(\d{3,5})\s*Hz\b", "Hz"),
        ("all_of", "connection_type", [(r"\bbluetooth\b", "Bluetooth"), (r"\bwireless\b|\b2\.?4\s*ghz\b", "Wireless"), (r"\bwired\b|\busb\b", "Wired")], None),
        ("first_of", "keyboardproduct_type", [("hall effect", "Hall Effect Keyboard"), ("mechanical", "Mechanical Keyboard")], None),
    ],
    "mouse": [
        ("first_of", "tracking_method", [("bamf 3.0", "PAW3950"), ("bamf 2.0", "PAW3395"), ("xs-1", "PAW3950"), ("focus pro", "PAW3950"), ("26k",
            "PAW3395"), ("4g hero", "HERO"), ("5g hero", "HERO")], None),
        ("regex", "tracking_method", r"\bPAW\d{3,4}(?:\s*(?:HS|SE|MAX|ULTRA|MASTER))?\b", "identity"),
        ("haze_weight", "weight", ["6369g", "6369 g"], [" tmr", "haze x1", "haze x ii"]),
        ("measurement", "weight", r"(?<!\d)(\d{1,4}(?:\.\d+)?)\s*g\b", "g"),
        ("measurement", "battery", r"(?<!\d)(\d{2,6})\s*mAh\b", "mAh"),
        ("dpi", "maximum_dpi", r"(?<!\d)(\d{1,3})\s*K\s*(?:DPI)?\b|(?<!\d)(\d{4,6})\s*DPI\b", None),
        ("all_of", "connection_type", [(r"\bbluetooth\b|\bbt\b", "Wireless BT"), (r"\b2\.?4\s*(?:ghz)?\b|\bwireless\b", "Wireless 2.4 GHZ"), (r"\bwired\b|\busb\b", "Wired")], None),
        ("first_of", "switch_type", [("d2fc-f-7n", "Omron D2FC-F-7N 100M"), ("omron", "Omron Mechanical"), ("optical", "Optical"),
            ("huano green shell", "Huano Green Shell White Dot"), ("huano blue shell", "Huano Blue Shell Pink Dot"), ("ttc gold", "TTC Gold"),
            ("kailh", "Kailh")], None),
        ("all_of", "grip_type", [("palm", "Palm"), ("claw", "Claw"), ("fingertip", "Fingertip")], None),
    ],
    "display": [("measurement", "refresh_rate", r"(?<!\d)(\d{2,4})\s*Hz\b", "Hz")],
    "mousepad": [
        ("first_of", "mousepad_speed", [("extremely fast", "Extremely fast"), ("very fast", "Very fast"), ("fast", "Fast"), ("quick", "Quick"),
            ("balanced", "Balanced"), ("control", "Control"), ("slow", "Slow"), ("very slow", "Very slow"), ("extremely slow", "Extremely slow")],
            None),
        ("first_of", "mousepad_texture", [("rough", "Rough"), ("textured", "Textured"), ("smooth", "Smooth")], None),
        ("first_of", "mousepad_firmness", [("very soft", "Very soft"), ("soft", "Soft"), ("firm", "Firm"), ("very firm", "Very firm"), ("hard", "Hard")], None),
        ("measurement", "thickness_mm", r"(?<!\d)(\d+(?:\.\d+)?)\s*mm\b", "mm"),
    ],
}
#: Characters of a field's value that are kept.
LONGEST = 200


def found(text: Column, pattern: str) -> Column:
    """Whether a pattern matches anywhere, ignoring case; words are Unicode's."""
    return text.rlike(f"(?iU){pattern}")


def detect_domains(text: Column, category: Column | None = None) -> Column:
    """Domains whose detectors match: a point for each in the text, two for each in the category; best first, then by name."""
    def score(value: Column, patterns: list[str]) -> Column:
        # most texts match none of a domain's detectors, which one look tells
        each = reduce(lambda a, b: a + b, [found(value, p).cast("int") for p in patterns])
        return F.when(found(value, "|".join(f"(?:{p})" for p in patterns)), each).otherwise(0)

    points = []
    for name, patterns in DETECT.items():
        n = score(text, patterns)
        if category is not None:
            n = n + 2 * score(category, patterns)
        points.append(F.struct((-n).alias("s"), F.lit(name).alias("name")))
    hit = F.filter(F.array(*points), lambda x: x["s"] < 0)
    return F.transform(F.array_sort(hit), lambda x: x["name"])


def related_domains(domains: Column) -> Column:
    """Domains that the given ones relate to and that aren't among them, in order, each once."""
    table = F.create_map(*[x for name in DETECT for x in (F.lit(name), F.array(*[F.lit(r) for r in RELATED.get(name, [])]).cast("array<string>"))])
    near = F.flatten(F.transform(domains, lambda d: F.coalesce(F.try_element_at(table, d), F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(near, lambda r: ~F.array_contains(domains, r)))


def whole_number(text: Column) -> Column:
    """Decimal text without its fraction and leading zeros."""
    return text.cast("decimal(38,10)").cast("bigint").cast("string")


def rule_value(rule: tuple, text: Column, device: Column) -> Column:
    """What a rule gives its field, null if it doesn't apply; ``text`` is lower-case, ``device`` keeps its case."""
    kind, _, what, more = rule
    if kind == "first_of":
        return reduce(lambda acc, r: acc.when(text.contains(r[0]), r[1]), what[1:], F.when(text.contains(what[0][0]), what[0][1]))
    if kind == "all_of":
        hits = F.filter(F.array(*[F.when(found(text, p), v) for p, v in what]), lambda x: x.isNotNull())
        return F.when(F.size(hits) > 0, F.array_join(F.array_distinct(hits), ", "))
    if kind == "haze_weight":
        here = (text.contains(what[0]) | text.contains(what[1])) & text.contains("ipi") & text.contains("haze")
        return F.when(here, F.when(reduce(lambda a, b: a | b, [text.contains(m) for m in more]), "69g").otherwise("63g"))
    group = lambda i: F.regexp_extract(device, f"(?iU){what}", i)
    if kind == "regex":
        value = F.upper(F.trim(F.regexp_replace(group(0), r"(?U)\s+", " "))) if more == "layout" else F.trim(F.regexp_replace(group(0), r"(?U)\s+", " "))
        if more == "layout":
            value = F.when(value == "TKL", "75%").when(value.rlike(r"^\d+$"), F.concat(value, F.lit("%"))).otherwise(value)
    elif kind == "dpi":
        value = F.when(group(1) != "", (group(1).cast("bigint") * 1000).cast("string")).otherwise(group(2).cast("bigint").cast("string"))
    elif more == "weight_g":
        grams = F.when(F.lower(group(2)) == "kg", (group(1).cast("decimal(38,10)") * 1000).cast("bigint").cast("string")).otherwise(whole_number(group(1)))
        value = F.concat(grams, F.lit("g"))
    else:
        value = F.concat(group(1), F.lit(f" {more}" if more in ("Hz", "mAh") else more))
    return F.when(found(device, what), value)


def domain_fields(text: Column, domains: Column, device: Column | None = None) -> Column:
    """field -> value that the rules of ``domains`` find, in their order; a field keeps its first value, cut to LONGEST characters.

    ``text`` is lower-case text already seen; ``device`` the same in its own
    case, where it differs. Null gives an empty map.
    """
    text = F.coalesce(text, F.lit(""))
    device = text if device is None else F.when(F.coalesce(device, F.lit("")) == "", text).otherwise(device)
    nothing = F.create_map().cast("map<string,string>")

    def add(acc: Column, entry: Column) -> Column:
        return F.when(F.map_contains_key(acc, entry["field"]), acc).otherwise(F.map_concat(acc, F.map_from_entries(F.array(entry))))

    def of(name: str, text: Column, device: Column) -> Column:
        entries = F.array(*[F.struct(F.lit(r[1]).alias("field"), F.left(F.trim(rule_value(r, text, device)), F.lit(LONGEST)).alias("value")) for r in RULES[name]])
        return F.when(F.array_contains(domains, name), F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))

    def merged(table: Column) -> Column:
        # the rules are worked out once a text, not once for each of its domains
        of_domain = lambda d: F.coalesce(*[F.when(d == name, table[name]) for name in RULES])
        every = F.flatten(F.filter(F.transform(domains, of_domain), lambda x: x.isNotNull()))
        return F.coalesce(F.aggregate(every, nothing, add), nothing)

    def ruled(both: Column) -> Column:
        return let(F.struct(*[of(name, both["text"], both["device"]).alias(name) for name in RULES]), merged)

    return let(F.struct(text.alias("text"), device.alias("device")), ruled)
