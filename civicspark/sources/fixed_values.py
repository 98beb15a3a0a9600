"""Published tables, names and file formats the results depend on."""

from __future__ import annotations

# Constituency seats by constituency id, compensatory seats by region id.
CONSTITUENCY_SEATS = {
    "10": 17, "11": 11, "12": 10, "13": 2, "14": 20,
    "15": 12, "16": 17, "17": 18, "18": 13, "19": 15,
}
REGION_LEVELLING_SEATS = {"7": 11, "8": 15, "9": 14}
REGION_NAMES = {"7": "Hovedstaden", "8": "Sjælland-Syddanmark", "9": "Midtjylland-Nordjylland"}

# Alliances of European elections by year, named by their member letters.
ALLIANCES = {
    2009: ["A_B_F", "C_I_V", "J_N", "O"],
    2014: ["A_B_F", "C_V", "I", "N", "O"],
    2019: ["A_F", "B_Å", "C_I_V", "N_Ø", "O"],
    2024: ["A_F_Å", "B_M_V", "C_I", "O", "Æ", "Ø"],
}

# Election catalogue.
EUROPEAN_FIRST_YEAR, EUROPEAN_INTERVAL = 2009, 5
NATIONAL_YEARS = [2011, 2015, 2019, 2022]
COUNT_KINDS = ["valgaften", "fintælling"]
COUNT_FILES = {"valgaften": "xml/valgdag.xml", "fintælling": "xml/fintal.xml"}
ELECTION_CODES = {
    ("EP", 2009): "Valg1191212",
    ("EP", 2014): "Valg1475795",
    ("EP", 2019): "Valg1684426",
    ("EP", 2024): "Valg2546524",
    ("FT", 2011): "Valg1204271",
    ("FT", 2015): "Valg1487635",
    ("FT", 2019): "Valg1684447",
    ("FT", 2022): "Valg1968094",
}
EUROPEAN_SEATS = {2009: 13, 2014: 13, 2019: 14, 2024: 15}
ORDERED_LIST_LETTERS = {2019: "OØÅ", 2024: "Ø"}

# Count document format.
NOT_READY = "Resultatet foreligger endnu ikke."
INDEPENDENT = "Uden for partier"
# level -> container, element, id attribute, parent id attribute
LEVELS = {
    "land": (None, "Land", "land_id", None),
    "landsdele": ("Landsdele", "Landsdel", "landsdel_id", "land_id"),
    "storkredse": ("Storkredse", "Storkreds", "storkreds_id", "landsdel_id"),
    "opstillingskredse": (
        "Opstillingskredse", "Opstillingskreds", "opstillingskreds_id", "storkreds_id",
    ),
    "afstemningsomraader": (
        "Afstemningsomraader", "Afstemningsomraade", "afstemningsomraade_id",
        "opstillingskreds_id",
    ),
}
PERSON_LEVELS = ("storkredse", "opstillingskredse", "afstemningsomraader")

# Gazetteer names, stadium names and cities that differ between sources.
CITY_NAMES = {
    "München": "Munich",
    "Freiburg im Breisgau": "Freiburg",
    "Frankfurt am Main": "Frankfurt",
    "Köln": "Cologne",
    "Münster": "Munster",
    "Nürnberg": "Nuremberg",
    "Mönchengladbach": "Monchengladbach",
}
MATCH_CITY_NAMES = {
    "Wurzburger": "Würzburg",
    "Hannover-List": "Hannover",
    "Mainz-Mombach": "Mainz",
}
STADIUM_NAMES = {
    "CASA Arena Horsens": "Hybel Arena Horsens",
    "Ceres Park": "New Vejlby Stadium",
    "Hvidovre Stadion": "Pro Ventilation Arena",
    "Sydbank Park": "Haderslev Football Stadium",
    "Parken": "Parken Stadium",
}
STADIUM_CITIES = {
    "Borussia-Park": "Monchengladbach",
    "Merkur Spiel-Arena": "Düsseldorf",
    "Ludwigspark Stadion": "Saarbrücken",
    "Sportpark Ronhof Thomas Sommer": "Fürth",
    "Maurice Dufrasnestadion": "Liège",
    "Bosuilstadion": "Antwerpen",
    "Easi Arena": "La Louvière",
}
# column searched (home team or city), text to find, city
CITY_RULES = [
    ("home", "anderlecht", "Anderlecht"),
    ("home", "gilloise", "Forest"),
    ("city", "anvers", "Antwerpen"),
    ("city", "deurne", "Antwerpen"),
    ("home", "mechelen", "Mechelen"),
    ("home", "truiden", "Sint-Truiden"),
    ("home", "liege", "Liège"),
    ("city", "heverlee", "Oud-Heverlee"),
]

# Fixed value: the population the countdown runs to.
POPULATION_TARGET = 6_000_000
