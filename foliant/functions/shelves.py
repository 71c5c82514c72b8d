"""Cleaning and display of shelf tags, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.scalars import title_case

# Tags that say nothing about a book
GENERIC = [
    "to-read", "currently-reading", "read", "owned", "default", "favorites", "favorite", "favourite", "favourites", "favorite-books",
    "favorites-owned", "all-time-favorites", "books-i-own", "book-i-own", "books-i-have", "owned-books", "own-it", "i-own", "mine", "have", "need",
    "want", "want-to-read", "need-to-buy", "need-to-get", "to-buy", "wish-list", "wishlist", "maybe", "my-books", "my-library", "my-shelf",
    "home-library", "library", "library-books", "library-book", "borrowed", "kindle", "ebook", "ebooks", "e-book", "e-books", "nook", "pdf",
    "calibre", "audiobook", "audiobooks", "audio", "audio-book", "audio-books", "audible", "paperback", "books", "book-club", "bookclub", "classroom",
    "classroom-library", "school", "reviewed", "finished", "completed-series", "series-to-read", "series-to-start", "part-of-a-series",
    "first-in-series", "first-in-a-series", "1st-in-series", "1st-in-a-series", "dnf", "did-not-finish", "didn-t-finish", "couldn-t-finish",
    "abandoned", "unfinished", "never-finished", "not-finished", "stopped-reading", "gave-up-on", "dropped", "paused", "on-hold", "half-read",
    "not-interested", "nope", "never-again", "must-read", "other",
]

# Authors and series that are no subject
BLOCKED = [
    "lynsay-sands", "lyndsay-sands", "sands", "sands-lynsay", "mari-mancusi", "john-connolly", "argeneau", "argeneau-series", "argeneau-vampires",
    "argeneau-vampire-series", "blood-coven", "blood-coven-series", "charlie-parker-series",
]

# The tag that stands for a variant
STANDS_FOR = {
    "sci-fi": "science-fiction", "scifi": "science-fiction", "sf": "science-fiction", "sci-fi-fantasy": "science-fiction",
    "scifi-fantasy": "science-fiction", "science-fiction-fantasy": "science-fiction", "speculative-fiction": "science-fiction",
    "speculative": "science-fiction", "graphic": "graphic-novels", "graphic-novel": "graphic-novels", "comic": "graphic-novels",
    "comics": "graphic-novels", "comic-book": "graphic-novels", "comic-books": "graphic-novels", "comics-graphic-novels": "graphic-novels",
    "graphic-novels-comics": "graphic-novels", "comics-and-graphic-novels": "graphic-novels", "graphic-novels-and-comics": "graphic-novels",
    "ya": "young-adult", "y-a": "young-adult", "ya-lit": "young-adult", "ya-books": "young-adult", "ya-fiction": "young-adult",
    "young": "young-adult", "young-adult-fiction": "young-adult", "children-s": "children", "childrens": "children", "childrens-books": "children",
    "children-s-books": "children", "children-s-literature": "children", "childrens-lit": "children", "children-s-lit": "children",
    "children-s-fiction": "children", "childrens-fiction": "children", "kid-lit": "children", "kids": "children", "kids-books": "children",
    "j-fiction": "juvenile-fiction", "middle-grades": "middle-grade", "historical": "historical-fiction", "historical_fiction": "historical-fiction",
    "historical-fic": "historical-fiction", "mystery-thriller": "thriller", "mystery-thrillers": "thriller", "thrillers": "thriller",
    "crime-fiction": "crime", "detective-fiction": "detective", "suspense-thriller": "suspense", "religious": "religion",
    "religious-fiction": "religion", "spiritual": "spirituality", "christianity": "christian", "non-fiction": "nonfiction", "bio": "biography",
    "biographies": "biography", "biographical": "biography", "autobiographies": "autobiography", "memoirs": "memoir", "adult-fiction": "fiction",
    "general-fiction": "fiction", "classic": "classics", "england": "british-literature", "british": "british-literature", "uk": "british-literature",
    "wwii": "world-war-ii", "ww2": "world-war-ii", "world-war-2": "world-war-ii", "vampire": "vampires", "vamps": "vampires", "vamp": "vampires",
    "vamp-books": "vampires", "vampire-books": "vampires", "vampire-novels": "vampires", "pnr": "paranormal-romance",
    "para-romance": "paranormal-romance", "romance-paranormal": "paranormal-romance", "adult-romance": "romance", "contemporary-romance": "romance",
    "romantic": "romance", "humour": "humor", "humorous": "humor", "newberry": "newbery", "newberry-books": "newbery", "newberys": "newbery",
    "newberry-honor": "newbery-honor",
}

# The display of tags that share one
FAMILY_OF = {
    "mystery": "Mystery & Thriller", "thriller": "Mystery & Thriller", "suspense": "Mystery & Thriller", "crime": "Crime & Detective",
    "detective": "Crime & Detective", "noir": "Crime & Detective", "vampires": "Vampires & Paranormal", "paranormal": "Vampires & Paranormal",
    "supernatural": "Vampires & Paranormal", "paranormal-romance": "Vampires & Paranormal", "religion": "Religion & Spirituality",
    "spirituality": "Religion & Spirituality", "faith": "Religion & Spirituality", "biography": "Memoir & Biography", "memoir": "Memoir & Biography",
    "autobiography": "Memoir & Biography", "war": "War & History", "world-war-ii": "War & History", "military": "War & History",
    "philosophy": "Philosophy & Ideas", "psychology": "Philosophy & Ideas", "self-help": "Self Help", "self-improvement": "Self Help",
    "dystopia": "Dystopian Fiction", "dystopian": "Dystopian Fiction", "post-apocalyptic": "Dystopian Fiction",
}

# Displays that differ from the tag in title case
OWN_DISPLAY = {"coming-of-age": "Coming of Age", "school": "School Stories", "children": "Children's Books", "20th-century": "20th Century"}

# Displays of low weight, their factor, and age displays from the most specific
GENERIC_DISPLAYS = ("Fiction", "Contemporary", "History", "Historical", "Nonfiction", "Adult", "Novels", "Novel", "Literature", "General", "Modern", "American", "English", "Translated")
GENERIC_FACTOR = 0.15
AGE_DISPLAYS = ("Middle Grade", "Young Adult", "Children's Books")

YEAR = r"^(\d{4}|read-\d{4}|read-in-\d{4}|\d{4}-reads?|read-\d{2})$"
STARS = r"^[1-5]-stars?$"
UTILITY = r"^(to-read-|currently-reading-|already-read-|re-read)"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def clean_shelves(raw: Column) -> Column:
    """The subject tags of a comma list, in order; repeats stay."""
    drop = F.array(*(F.lit(t) for t in GENERIC + BLOCKED))
    tokens = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda t: F.replace(F.lower(F.trim(t)), F.lit("_"), F.lit("-")))
    good = F.filter(tokens, lambda t: F.length(t).between(1, 35) & (F.regexp_count(t, F.lit("[A-Za-z]")) >= 2) & ~t.rlike(YEAR) & ~t.rlike(STARS) & ~t.rlike(UTILITY) & ~F.array_contains(drop, t))
    return F.filter(F.transform(good, lambda t: F.coalesce(F.try_element_at(literal_map(STANDS_FOR), t), t)), lambda t: ~F.array_contains(drop, t))


def display(shelf: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(FAMILY_OF), shelf), F.try_element_at(literal_map(OWN_DISPLAY), shelf), title_case(shelf))


def shelf_weight(rank: Column) -> Column:
    """Of a member's rank in its cluster: 3 up to 10, 1.5 up to 50, else 1."""
    return F.when(rank <= 10, F.lit(3.0)).when(rank <= 50, F.lit(1.5)).otherwise(F.lit(1.0))


def generic_factor(name: Column) -> Column:
    return F.when(name.isin(*GENERIC_DISPLAYS), F.lit(GENERIC_FACTOR)).otherwise(F.lit(1.0))
