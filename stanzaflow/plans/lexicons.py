"""Small Latin lexicons for the queries; the texts of the tables are invented prose in four languages."""

FAMILIES = {
    "ontion": "a", "tion": "a", "ation": "a", "then": "b", "hent": "b", "thent": "b",
    "ing": "c", "inging": "c", "schaft": "d", "ción": "d", "eau": "e", "elle": "e",
}
WORDS = sorted(FAMILIES, key=lambda w: (-len(w), w))
TAGS = ["that", "with", "from", "this", "have", "only", "über", "nicht", "durch", "dans", "pour", "avec", "para", "como", "entre"]
REGION = {"en": "north", "de": "north", "fr": "south", "es": "south"}
EMOTIONS = {
    "calm": [("the", 0.48), ("ther", 1.0), ("with the", 1.8)],
    "grief": [("ent", 0.48), ("tion", 1.0), ("ontion", 1.8)],
    "joy": [("ing", 1.0), ("eau", 1.0), ("ción", 1.8)],
    "fear": [("sch", 0.48), ("erst", 1.0), ("schaft", 1.8)],
}
DIMENSIONS = [("calm", 0.5, 0.2, 0.6), ("grief", -0.7, 0.4, 0.3), ("joy", 0.8, 0.6, 0.7), ("fear", -0.6, 0.8, 0.2)]
EXCLUDED = ["of tion", "und schaft"]
NEGATORS = ["not ", "nicht ", "pas "]
SEASONS = {
    "spring": {"ontion": 8, "tion": 3, "eau": 6}, "summer": {"ing": 3, "inging": 8, "elle": 6},
    "autumn": {"then": 6, "hent": 8, "ent": 3}, "winter": {"erst": 8, "sch": 3, "ción": 6},
}
CLUSTERS = {"ation": ("grief", 0.36), "elle": ("joy", 0.3), "hent": ("fear", 0.25)}
NUMBERS = {  # word: (kind, size)
    "ontion": ("single", 1.0), "schaft": ("hundred", 2.0), "ción": ("thousand", 3.0), "eau": ("myriad", 4.0), "ing": ("weak", 0.0), "ent": ("ordinal", 0.0),
}
COMPANIONS = {"moon": ["ontion", "eau"], "wind": ["schaft"], "rain": ["ción", "inging"]}
