"""Vocabulary used to read questions: fixed word lists plus per-catalogue settings.

The word lists below are fixed values: results depend on every entry.  Product
names are not part of them -- a catalogue brings its own system aliases, brand
words and prompts through :class:`Vocabulary`.
"""
from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: trade synonym groups (English / French / Arabic) -----------
SYNONYM_GROUPS: tuple[tuple[str, ...], ...] = (
    ("frame", "dormant", "cadre", "outer", "إطار", "اطار"),
    ("sash", "ouvrant", "vantail", "leaf", "panel"),
    ("glazing", "bead", "parclose", "glass", "vitrage", "خرزة", "زجاج"),
    ("gasket", "seal", "joint", "weatherstrip", "weatherseal", "epdm"),
    ("brush", "broom", "brosse"),
    ("hinge", "paumelle", "charniere", "pivot", "مفصلة", "مفصلات"),
    ("lock", "serrure", "locking", "cremone", "espagnolette", "keep", "striker", "قفل", "اقفال"),
    ("handle", "poignee", "bequille", "lever", "مقبض", "مقابض"),
    ("threshold", "seuil", "sill"),
    ("mullion", "meneau", "transom", "traverse", "post"),
    ("profile", "profil", "section", "extrusion"),
    ("crosssection", "section", "coupe", "sectional"),
    ("thermal", "thermique", "insulation", "isolation", "rpt", "break", "barrette"),
    ("lift", "levant", "liftslide", "levantcoulissant"),
    ("slide", "sliding", "coulissant", "coulissante"),
    ("roller", "galet", "chariot", "carriage", "wheel", "trolley"),
    ("rail", "track", "glissiere", "guide", "سكة", "سكت"),
    ("drainage", "drain", "evacuation", "weep", "water"),
    ("reinforcement", "renfort", "stiffener"),
    ("cleat", "equerre", "corner", "angle", "bracket"),
    ("screw", "vis", "fixing", "fastener"),
    ("machining", "usinage", "punching", "poinconnage", "drilling", "tooling", "tool"),
    ("assembly", "assemblage", "montage", "fabrication"),
    ("opening", "ouverture", "outward", "inward", "casement"),
    ("door", "porte", "باب", "ابواب"),
    ("window", "fenetre", "نافذة", "نافذه", "شباك"),
    ("weight", "poids", "capacity", "load"),
    ("dimension", "size", "dimensions", "clearance", "tolerance"),
    ("accessory", "accessoire", "hardware", "quincaillerie"),
    ("aluminium", "aluminum", "alu"),
    ("colour", "color", "coloris", "finish", "ral", "anodised", "anodized", "lacquered"),
)

# --- fixed values: words that carry no subject --------------------------------
STOP_WORDS: tuple[str, ...] = (
    "the", "a", "an", "and", "or", "of", "for", "to", "in", "on", "at", "is",
    "are", "was", "be", "with", "by", "from", "as", "it", "its", "this", "that",
    "what", "which", "how", "where", "when", "who", "why", "can", "do", "does",
    "i", "you", "we", "me", "my", "please", "show", "give", "tell", "need",
    "want", "find", "get", "there", "any", "some", "have", "has", "about",
    "le", "la", "les", "un", "une", "des", "du", "de", "et", "ou", "est",
    "pour", "avec", "sur", "dans", "quel", "quelle", "quelles", "quels",
    "comment", "que", "qui", "je", "vous", "nous", "il", "elle",
)

# --- fixed values: category-level words ---------------------------------------
BROAD_WORDS: tuple[str, ...] = (
    "door", "doors", "porte", "portes", "window", "windows", "fenetre", "fenetres",
    "aluminium", "aluminum", "alu", "metal", "steel",
    "profile", "profiles", "profil", "section", "sections",
    "system", "systems", "systeme", "systemes", "range", "ranges", "gamme", "gammes",
    "product", "products", "produit", "produits", "solution", "solutions",
    "hardware", "accessory", "accessories", "accessoire", "accessoires",
    "spec", "specs", "specification", "specifications", "performance", "performances",
    "type", "types", "model", "models", "modele", "option", "options",
    "frame", "frames", "sliding", "coulissant",
)

# --- fixed values: words that ask for pictures --------------------------------
DRAWING_WORDS: tuple[str, ...] = (
    "drawing", "drawings", "section", "crosssection", "cross", "figure",
    "diagram", "detail", "sketch", "plan", "coupe", "schema", "image",
    "images", "photo", "picture", "illustration", "visual", "look", "see",
)

# --- fixed values: small talk -------------------------------------------------
GREETINGS: tuple[str, ...] = (
    "hi", "hello", "hey", "yo", "bonjour", "salut", "coucou", "hola",
    "thanks", "thank", "merci", "ok", "okay", "bye", "goodbye", "test",
)
HELP_COMPANIONS: tuple[str, ...] = ("help", "me", "you", "please", "aide", "aidez")
HELP_WORDS: tuple[str, ...] = ("help", "aide", "aidez")
VAGUE_WORDS: tuple[str, ...] = (
    "help", "info", "information", "general", "overview", "summary",
    "introduction", "everything", "anything", "catalogue", "catalog",
)
GREETING_OPENERS: tuple[str, ...] = (
    "hi", "hello", "hey", "bonjour", "salut", "thanks", "merci", "ok",
)

# --- fixed values: scope of the assistant -------------------------------------
DOMAIN_TERMS: tuple[str, ...] = (
    "profile", "glazing", "bead", "hinge", "punching", "door", "window",
    "aluminium", "aluminum", "catalog", "frame", "sash", "threshold", "gasket",
    "accessory", "accessories", "part", "series", "system", "calculation",
    "weight", "reference", "kg", "chariot", "broom", "seal",
)
OUT_OF_SCOPE_TERMS: tuple[str, ...] = (
    "recipe", "cook", "rice", "chicken", "cake", "weather", "football", "soccer",
    "joke", "story", "music", "movie", "politics", "religion", "health", "medical",
)

# --- fixed values: reference-pattern vocabulary -------------------------------
PATTERN_KIND_WORDS: dict[str, tuple[str, ...]] = {
    "accessory": ("accessory", "accessories", "accessoire", "accessoires", "hardware"),
    "profile": ("profile", "profiles", "profil", "profils", "extrusion", "extrusions"),
}
PATTERN_STOP_WORDS: tuple[str, ...] = (
    "a", "an", "the", "it", "them", "this", "that", "any", "all",
    "part", "parts", "ref", "reference", "references", "number",
    "numbers", "digit", "digits", "piece", "pieces",
)
REFERENCE_NOUNS: tuple[str, ...] = (
    "profile", "profiles", "profil", "profils", "profile's",
    "accessory", "accessories", "accessoire", "accessoires",
    "part", "parts", "piece", "pieces", "item", "items",
    "reference", "references", "ref", "refs", "referenced",
    "code", "codes", "number", "numbers", "numero", "numéro",
)
FACET_KIND_WORDS: dict[str, tuple[str, ...]] = {
    "profile": ("profile", "profiles", "profil", "extrusion", "section", "sections"),
    "accessory": ("accessory", "accessories", "accessoire", "accessoires",
                  "hardware", "quincaillerie", "fitting", "fittings"),
}

# --- fixed values: headings that are page furniture ---------------------------
HEADING_STOP: tuple[str, ...] = (
    "PARTS LIST", "ITEM & REFERENCE", "SECTIONS", "MACHINING", "TOOLS", "EDITION",
    "PAGE", "REF", "NOTA", "NOTE", "CONCEPT", "RANGES", "SOLUTIONS",
)

# --- fixed values: French catalogue terms shown in English --------------------
FRENCH_TO_ENGLISH: tuple[tuple[str, str], ...] = (
    ("paumelle", "hinge"), ("ouvrant", "sash"), ("dormant", "frame"),
    ("coulissant", "sliding"), ("levage", "lift"), (r"joint\s*brosse", "brush seal"),
    ("parclose", "glazing bead"), ("batt[ée]e", "leaf"), ("chariot", "roller carriage"),
    ("poign[ée]e", "handle"), ("serrure", "lock"), ("gâche", "strike plate"),
    ("partition", "partition"), ("seuil", "threshold"), ("traverse", "crosspiece"),
    ("montant", "mullion"), ("étanch[ée]it[ée]", "sealing"), ("quincaillerie", "hardware"),
    ("profil[ée]?", "profile"), ("vitrage", "glazing"), ("d[ée]billard", "sliding"),
    ("galandage", "pocket"), (r"à\s*frappe", "casement"),
)

# --- fixed values: thresholds -------------------------------------------------
COMMON_TOKEN_SHARE = 0.30


@dataclass(frozen=True)
class Vocabulary:
    """Everything about question reading that a catalogue may configure."""

    #: system name -> lower-case phrases that name it in a question, in priority order
    system_aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: system name -> regular expression found in a folder or file name
    system_patterns: dict[str, str] = field(default_factory=dict)
    #: model words that qualify a question without being its subject
    system_words: tuple[str, ...] = ()
    #: codes that look like references but name a product family
    system_codes: tuple[str, ...] = ()
    #: brand words, treated as category words and as in scope
    brand_words: tuple[str, ...] = ()
    #: questions always offered by autocomplete when the typed text occurs in them
    prompts: tuple[str, ...] = ()
    #: lower-case phrases of a contents page, and the one that a divider page consists of
    contents_markers: tuple[str, ...] = ("contents",)
    divider_marker: str = "contents"

    @property
    def broad_words(self) -> tuple[str, ...]:
        return BROAD_WORDS + self.brand_words

    @property
    def domain_terms(self) -> tuple[str, ...]:
        return DOMAIN_TERMS + self.brand_words + self.system_words

    @property
    def heading_stop(self) -> tuple[str, ...]:
        return HEADING_STOP + tuple(w.upper() for w in self.brand_words)

    @property
    def synonyms(self) -> dict[str, list[str]]:
        """word -> every member of every group that holds it, sorted."""
        table: dict[str, set[str]] = {}
        for group in SYNONYM_GROUPS:
            for word in group:
                table.setdefault(word, set()).update(group)
        return {word: sorted(group) for word, group in table.items()}
