"""Rule tables: fixed values that results depend on.  Where the first match wins, order matters.

Kept as plain data; ``operators`` turn them into CASE expressions or small broadcast tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNKNOWN = "UNKNOWN"
ROOM_TONE = "AMB-ROOM-TONE"
NO_RESPONSE = "[no response]"

# The category vocabulary (key: category, sub-category, catalogue id, description).
VOCABULARY = {
    "AMB-URBAN": ("AMBIENCE", "URBAN", "AMBUrbn", "Dense city, traffic, pedestrians, horns"),
    "AMB-SUBURBAN": ("AMBIENCE", "SUBURBAN", "AMBSubn", "Quiet residential street, lawnmowers, birds"),
    "AMB-TOWN": ("AMBIENCE", "TOWN", "AMBTown", "Small town village, light activity"),
    "AMB-TRAFFIC": ("AMBIENCE", "TRAFFIC", "AMBTraf", "Pure traffic, highway, no pedestrians"),
    "AMB-PARK": ("AMBIENCE", "PARK", "AMBPark", "City park, light human activity"),
    "AMB-FOREST": ("AMBIENCE", "FOREST", "AMBForst", "Trees, birds, wind in trees"),
    "AMB-RURAL": ("AMBIENCE", "RURAL", "AMBRurl", "Countryside, away from people"),
    "AMB-ALPINE": ("AMBIENCE", "ALPINE", "AMBAlpn", "Mountain ambience"),
    "AMB-DESERT": ("AMBIENCE", "DESERT", "AMBDsrt", "Quiet desert, insects"),
    "AMB-SEASIDE": ("AMBIENCE", "SEASIDE", "AMBSea", "Beach with people, oceanside"),
    "AMB-LAKESIDE": ("AMBIENCE", "LAKESIDE", "AMBLake", "Lake scenes"),
    "AMB-TROPICAL": ("AMBIENCE", "TROPICAL", "AMBTrop", "Jungle, rainforest"),
    "AMB-FARM": ("AMBIENCE", "FARM", "AMBFarm", "Farm with animals, tractors"),
    "AMB-OFFICE": ("AMBIENCE", "OFFICE", "AMBOffc", "Workplace, typing, phones"),
    "AMB-RESTAURANT": ("AMBIENCE", "RESTAURANT & BAR", "AMBRest", "Restaurants, bars, dining"),
    "AMB-PUBLIC": ("AMBIENCE", "PUBLIC PLACE", "AMBPubl", "Stores, lobbies, malls, museums"),
    "AMB-MARKET": ("AMBIENCE", "MARKET", "AMBMrkt", "Busy market, vendors, crowds"),
    "AMB-SCHOOL": ("AMBIENCE", "SCHOOL", "AMBSchl", "Classroom, hallway, school bells"),
    "AMB-HOSPITAL": ("AMBIENCE", "HOSPITAL", "AMBHosp", "Hospital, surgery, ER"),
    "AMB-RELIGIOUS": ("AMBIENCE", "RELIGIOUS", "AMBRlgn", "Church, temple, services"),
    "AMB-TRANSPORT": ("AMBIENCE", "TRANSPORTATION", "AMBTran", "Train station, airport, bus station"),
    "AMB-RESIDENTIAL": ("AMBIENCE", "RESIDENTIAL", "AMBHome", "Apartment, house with some activity"),
    "AMB-ROOM-TONE": ("AMBIENCE", "ROOM TONE", "AMBRoom", "Empty room, no activity, just air"),
    "AMB-CONSTRUCTION": ("AMBIENCE", "CONSTRUCTION", "AMBCnst", "Jackhammers, cranes, road construction"),
    "AMB-INDUSTRIAL": ("AMBIENCE", "INDUSTRIAL", "AMBInd", "Warehouse, factory, plant"),
    "AMB-HITECH": ("AMBIENCE", "HITECH", "AMBTech", "Data center, control room, lab"),
    "AMB-UNDERGROUND": ("AMBIENCE", "UNDERGROUND", "AMBUndr", "Cave, sewer, bunker, tunnel, parking"),
    "AMB-UNDERWATER": ("AMBIENCE", "UNDERWATER", "AMBUndwtr", "Deep underwater bubbles"),
    "AMB-NAUTICAL": ("AMBIENCE", "NAUTICAL", "AMBNaut", "Ships at sea, shipyard"),
    "WATR-SURF": ("WATER", "SURF", "WATRSurf", "Ocean roar, constant waves (above water)"),
    "WATR-WAVE": ("WATER", "WAVE", "WATRWave", "Distinct individual waves"),
    "WATR-WATERFALL": ("WATER", "WATERFALL", "WATRFall", "Waterfalls"),
    "WATR-FLOW": ("WATER", "FLOW", "WATRFlow", "River, creek, stream"),
    "WATR-UNDERWATER": ("WATER", "UNDERWATER", "WATRUndwtr", "Underwater swimming, currents"),
    "VEH-INTERIOR": ("VEHICLES", "INTERIOR", "VEHInt", "Car/truck interior ambience"),
    "VEH-CAR": ("VEHICLES", "CAR", "VEHCar", "Cars (engine, by, idle)"),
    "CRWD-WALLA": ("CROWDS", "WALLA", "CRWDWalla", "Clean crowd murmur, no words"),
}

# The categories that a picture's two-line prompt offers.
PROMPT_CATEGORIES = [
    "AMB-URBAN", "AMB-TRAFFIC", "AMB-SUBURBAN", "AMB-PARK",
    "AMB-FOREST", "AMB-RURAL", "AMB-SEASIDE", "AMB-LAKESIDE", "AMB-FARM", "AMB-DESERT",
    "AMB-OFFICE", "AMB-RESTAURANT", "AMB-PUBLIC", "AMB-MARKET", "AMB-SCHOOL",
    "AMB-RESIDENTIAL", "AMB-ROOM-TONE",
    "AMB-CONSTRUCTION", "AMB-INDUSTRIAL",
    "AMB-UNDERGROUND", "AMB-NAUTICAL",
    "WATR-SURF", "WATR-WATERFALL", "WATR-FLOW",
    "VEH-INTERIOR", "CRWD-WALLA",
]

# The category that is opposed to each.
OPPOSITE = {
    "AMB-URBAN": "AMB-UNDERGROUND",
    "AMB-SUBURBAN": "AMB-INDUSTRIAL",
    "AMB-TOWN": "AMB-FOREST",
    "AMB-TRAFFIC": "AMB-FOREST",
    "AMB-PARK": "AMB-INDUSTRIAL",
    "AMB-FOREST": "AMB-URBAN",
    "AMB-RURAL": "AMB-URBAN",
    "AMB-ALPINE": "AMB-MARKET",
    "AMB-DESERT": "AMB-TROPICAL",
    "AMB-SEASIDE": "AMB-OFFICE",
    "AMB-LAKESIDE": "AMB-URBAN",
    "AMB-TROPICAL": "AMB-DESERT",
    "AMB-FARM": "AMB-OFFICE",
    "AMB-OFFICE": "AMB-FOREST",
    "AMB-RESTAURANT": "AMB-ROOM-TONE",
    "AMB-PUBLIC": "AMB-FOREST",
    "AMB-MARKET": "AMB-ROOM-TONE",
    "AMB-SCHOOL": "AMB-ROOM-TONE",
    "AMB-HOSPITAL": "AMB-FOREST",
    "AMB-RELIGIOUS": "AMB-MARKET",
    "AMB-TRANSPORT": "AMB-FOREST",
    "AMB-RESIDENTIAL": "AMB-CONSTRUCTION",
    "AMB-ROOM-TONE": "AMB-CONSTRUCTION",
    "AMB-CONSTRUCTION": "AMB-ROOM-TONE",
    "AMB-INDUSTRIAL": "AMB-FOREST",
    "AMB-HITECH": "AMB-FOREST",
    "AMB-UNDERGROUND": "AMB-SEASIDE",
    "AMB-UNDERWATER": "AMB-DESERT",
    "AMB-NAUTICAL": "AMB-INDUSTRIAL",
    "WATR-SURF": "AMB-OFFICE",
    "WATR-WAVE": "AMB-ROOM-TONE",
    "WATR-WATERFALL": "AMB-OFFICE",
    "WATR-FLOW": "AMB-URBAN",
    "WATR-UNDERWATER": "AMB-DESERT",
    "VEH-INTERIOR": "AMB-FOREST",
    "VEH-CAR": "AMB-RELIGIOUS",
    "CRWD-WALLA": "AMB-ROOM-TONE",
}

# Catalogue ids in the search scope of a category (UNKNOWN is in every scope).
SCOPE = {
    "WATR-SURF": ["WATRSurf", "WATRWave", "AMBSea"],
    "WATR-WAVE": ["WATRSurf", "WATRWave", "AMBSea"],
    "WATR-WATERFALL": ["WATRFall"],
    "WATR-FLOW": ["WATRFlow"],
    "WATR-UNDERWATER": ["WATRUndwtr"],
    "AMB-URBAN": ["AMBUrbn", "AMBTraf", "AMBTown", "AMBTran"],
    "AMB-TRAFFIC": ["AMBTraf", "AMBUrbn"],
    "AMB-FOREST": ["AMBForst", "AMBRurl"],
    "AMB-RURAL": ["AMBRurl", "AMBForst", "AMBAlpn"],
    "AMB-DESERT": ["AMBDsrt", "AMBRurl"],
    "AMB-SEASIDE": ["AMBSea", "WATRSurf"],
    "AMB-LAKESIDE": ["AMBLake", "AMBSea"],
    "AMB-TROPICAL": ["AMBTrop", "AMBForst"],
    "AMB-ROOM-TONE": ["AMBRoom", "AMBHome"],
    "AMB-RESIDENTIAL": ["AMBHome", "AMBRoom"],
    "AMB-OFFICE": ["AMBOffc", "AMBPubl"],
    "AMB-RESTAURANT": ["AMBRest", "AMBPubl"],
    "AMB-PUBLIC": ["AMBPubl", "AMBRest", "AMBOffc", "AMBMrkt"],
    "AMB-MARKET": ["AMBMrkt", "AMBPubl"],
    "AMB-TRANSPORT": ["AMBTran", "AMBUrbn"],
    "AMB-RELIGIOUS": ["AMBRlgn", "AMBPubl"],
    "AMB-UNDERGROUND": ["AMBUndr", "AMBTran"],
    "AMB-INDUSTRIAL": ["AMBInd", "AMBCnst"],
    "AMB-CONSTRUCTION": ["AMBCnst", "AMBInd"],
    "AMB-HITECH": ["AMBTech", "AMBOffc"],
    "VEH-INTERIOR": ["VEHInt"],
    "VEH-CAR": ["VEHCar", "AMBTraf"],
    "CRWD-WALLA": ["CRWDWalla", "AMBPubl"],
}

# Catalogue ids that are wrong for a category.
WRONG = {
    "WATR-SURF": ["WATRUndwtr"],
    "AMB-URBAN": ["AMBUndr", "WATRUndwtr", "AMBRoom"],
    "AMB-ROOM-TONE": ["WATRUndwtr", "AMBInd"],
    "AMB-FOREST": ["WATRUndwtr", "AMBUrbn", "AMBDsrt"],
    "AMB-DESERT": ["WATRUndwtr", "AMBUrbn"],
    "AMB-SEASIDE": ["WATRUndwtr"],
    "AMB-LAKESIDE": ["WATRUndwtr"],
}

# Path parts that fix a catalogue id; the first match wins.
OVERRIDES = [
    ("underground car park", "AMBUndr"),
    ("underground garage", "AMBUndr"),
    ("underground lab", "AMBUndr"),
    ("car park", "AMBUndr"),
    ("parking garage", "AMBUndr"),
]

# Words that a file name's prefix stands for; the first match wins.
PREFIX_HINTS = [
    ("UWT", "underwater water aquatic submerged"),
    ("3DS", "ambience interior room tone enclosed indoor"),
    ("QP", "quiet ambience background"),
    ("UWA", "underwater bubbles water"),
    ("SND", "sound effect foley"),
]

# Words of a description that stand for a category; the first match wins.
DESCRIPTION_HINTS = [
    ("forest", "AMB-FOREST"),
    ("city", "AMB-URBAN"),
    ("traffic", "AMB-URBAN"),
    ("highway", "AMB-TRAFFIC"),
    ("airport", "AMB-PUBLIC"),
    ("beach", "AMB-SEASIDE"),
    ("ocean", "AMB-SEASIDE"),
    ("desert", "AMB-DESERT"),
    ("tunnel", "AMB-UNDERGROUND"),
    ("cave", "AMB-UNDERGROUND"),
    ("construction", "AMB-CONSTRUCTION"),
    ("fireplace", "AMB-RESIDENTIAL"),
    ("lake", "AMB-LAKESIDE"),
    ("river", "AMB-RURAL"),
]

# Words that vote for a catalogue id; most votes win, the first of equals.
KEYWORDS = [
    ("WATRSurf", ["waves coming in", "ocean waves", "surf"]),
    ("WATRUndwtr", ["underwater", "uwt", "submerged", "hydrophone"]),
    ("WATRFall", ["waterfall", "falls"]),
    ("WATRFlow", ["river", "creek", "stream"]),
    ("AMBUrbn", ["city", "urban", "downtown", "tram", "metro"]),
    ("AMBTraf", ["traffic", "highway", "motorway"]),
    ("AMBForst", ["forest", "woodland", "woods"]),
    ("AMBSea", ["beach", "seaside", "coastal"]),
    ("AMBRurl", ["rural", "countryside", "village"]),
    ("CRWDWalla", ["crowd", "walla", "murmur"]),
]

# The text that stands for each catalogue id in zero-shot classification, in order.
ANCHORS = [
    ("WATRSurf", "ocean waves crashing on shore above water surface sea waves surf roar"),
    ("WATRUndwtr", "underwater recording submerged hydrophone deep ocean aquatic bubbles swimming"),
    ("WATRFall", "waterfall cascading water falls splashing heavy water"),
    ("WATRFlow", "river stream creek flowing water bubbling brook"),
    ("WATRWave", "individual ocean waves splashing shore water"),
    ("AMBSea", "beach seaside coastal ocean shore people seagulls seaside ambience"),
    ("AMBLake", "lake water gentle lapping shore birds quiet"),
    ("AMBNaut", "ship boat nautical sea docks gulls waves harbour"),
    ("AMBUrbn", "city urban street traffic pedestrians trams buses horns sirens busy downtown"),
    ("AMBSubn", "suburban residential neighborhood lawnmower birds children playing quiet"),
    ("AMBTraf", "highway traffic cars engines road busy motorway"),
    ("AMBTown", "small town village light traffic church bell activity"),
    ("AMBPark", "city park wind trees children playing fountain outdoor"),
    ("AMBForst", "forest woodland birds wind trees leaves rustling wilderness"),
    ("AMBDsrt", "desert wind sand dunes arid landscape dry wind hiss"),
    ("AMBRurl", "rural countryside prairie meadow nature farm"),
    ("AMBTrop", "jungle rainforest tropical insects birds exotic nature"),
    ("AMBFarm", "farm animals tractor rooster nature countryside"),
    ("ANIMBird", "birds chirping singing forest nature wings wildlife"),
    ("ANIMInsct", "insects crickets grasshoppers buzzing summer"),
    ("AMBRoom", "empty room tone quiet indoor air hum silence ventilation"),
    ("AMBHome", "residential apartment home interior ambience daily life"),
    ("AMBOffc", "office workplace typing voices phones printer activity"),
    ("AMBRest", "restaurant bar cafe dining crowd dishes glasses chatter"),
    ("AMBPubl", "airport mall lobby museum public indoor crowd shopping center supermarket"),
    ("AMBMrkt", "outdoor market vendors crowd busy street market"),
    ("AMBTran", "train station subway airport terminal transportation hub"),
    ("AMBSchl", "school classroom hallway children talking bells"),
    ("AMBHosp", "hospital medical monitor beeps quiet voices surgery clinic"),
    ("AMBRlgn", "monks chanting temple religious scriptures church prayer"),
    ("AMBUndr", "underground car park parking garage basement enclosed reverb tunnel cave"),
    ("AMBInd", "industrial factory warehouse machinery plant metal workshop"),
    ("AMBCnst", "construction site jackhammer crane machinery outdoor concrete mixer"),
    ("AMBTech", "server room data center fans hum computers electronics"),
    ("VEHInt", "car interior cabin engine hum road noise driving"),
    ("VEHCar", "car engine driving traffic street vehicle auto"),
    ("CRWDWalla", "crowd murmur walla people talking indistinct background chatter"),
    ("TOOLWork", "hand tools impact manual work toolbox metal wood scraping"),
    ("WOODChopp", "chopping wood axe hitting tree timber forest wood work"),
    ("METLWork", "metal workshop clanging grinding tools factory workshop"),
]

# Path parts that exclude a file for a category; none requires any.
EXCLUDED = {
    "WATR-SURF": ["UWT", "underwater", "submerged", "hydrophone", "below water"],
    "WATR-WAVE": ["UWT", "underwater", "submerged", "hydrophone"],
    "AMB-SEASIDE": ["UWT", "underwater", "submerged", "hydrophone"],
    "AMB-URBAN": ["underground", "car park", "basement", "UWT", "garage"],
    "AMB-ROOM-TONE": ["UWT", "outdoor", "exterior", "traffic", "birds"],
    "AMB-FOREST": ["traffic", "car", "city", "urban", "industrial"],
}

# Texts of negative queries that replace the opposed category's, and narrower scopes.
NEGATIVE_TEXT = {
    "WATR-SURF": "submerged hydrophone below surface deep water recording",
    "WATR-WAVE": "submerged hydrophone below surface deep water recording",
    "AMB-SEASIDE": "submerged hydrophone below surface deep water recording",
    "AMB-URBAN": "indoor enclosed parking underground garage quiet",
}
SUB_INDEX = {
    "WATR-SURF": ["WATRSurf", "WATRWave", "AMBSea"],
    "WATR-WAVE": ["WATRWave", "WATRSurf"],
    "AMB-SEASIDE": ["AMBSea", "WATRSurf"],
    "AMB-URBAN": ["AMBUrbn", "AMBTown", "AMBTraf"],
    "AMB-ROOM-TONE": ["AMBRoom", "AMBHome"],
    "AMB-UNDERGROUND": ["AMBUndr"],
    "AMB-FOREST": ["AMBForst", "AMBRurl", "AMBAlpn"],
}

# Words that make a negative line unusable; words that are no tags.
DANGER = ["no ", "without", "quiet", "silent", "muffled"]
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "from", "by", "is",
    "are", "was", "were", "be", "been", "has", "have", "had", "this", "that", "these", "those",
]

# Quality of a model file by a part of its name; the first match wins.
QUANTISATION = [
    ("bf16", 1.0),
    ("f16", 1.0),
    ("q8_0", 0.9),
    ("q6_k", 0.85),
    ("q5_k", 0.8),
    ("q4_k", 0.75),
    ("q4_0", 0.7),
    ("q3_k", 0.65),
    ("q2_k", 0.5),
]

# Exact frame rates (about, numerator, denominator).
BROADCAST_RATES = [(23.976, 24000, 1001), (29.97, 30000, 1001), (59.94, 60000, 1001), (47.952, 48000, 1001)]


def table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A rule table of a fixed size as a DataFrame, without Python in the plan."""
    from pyspark.sql import functions as F

    import json

    names = [c.strip().rsplit(" ", 1)[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def vocabulary(spark: SparkSession) -> DataFrame:
    return table(spark, [(k, *v) for k, v in VOCABULARY.items()], "key string, cat string, sub string, catid string, descr string")


def scope(spark: SparkSession) -> DataFrame:
    """(category, allowed): the scope of each category, UNKNOWN included."""
    return table(spark, [(k, [*v, UNKNOWN]) for k, v in SCOPE.items()], "category string, allowed array<string>")


def wrong(spark: SparkSession) -> DataFrame:
    return table(spark, list(WRONG.items()), "category string, bad array<string>")


def opposite(spark: SparkSession) -> DataFrame:
    return table(spark, list(OPPOSITE.items()), "category string, negative string")


def excluded(spark: SparkSession) -> DataFrame:
    return table(spark, list(EXCLUDED.items()), "category string, patterns array<string>")


def negative_text(spark: SparkSession) -> DataFrame:
    """(category, text): what a negative query says where the opposed category's own text won't do."""
    return table(spark, list(NEGATIVE_TEXT.items()), "category string, text string")


def narrow_scope(spark: SparkSession) -> DataFrame:
    """(category, narrow): catalogue ids of a category's narrower scope."""
    return table(spark, list(SUB_INDEX.items()), "category string, narrow array<string>")
