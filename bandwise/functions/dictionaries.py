"""Fixed dictionaries of the normalization rules. Everything here is a fixed value."""

# --- fixed values: colour aliases per canonical colour --------------------------------
COLOR_ALIASES = {
    "white": [
        "grand prix white", "alpine white", "ivory white", "white", "weiss", "chalk white",
        "carrara white", "polar silver", "polar white", "diamond silver white", "linen",
        "cream white", "1k3 white",
    ],
    "silver": [
        "silver", "silver metallic", "arctic silver", "arctic silver metallic", "seal grey",
        "platinum", "cashmere", "silver rose", "cool silver", "bright silver", "techno silver",
    ],
    "grey": [
        "slate grey", "dark grey", "graphite grey", "agate grey", "basalt grey", "stone grey",
        "grau", "dove grey", "anthracite grey", "umber grey", "quartz grey", "meteor grey",
    ],
    "grey-metallic": [
        "slate grey metallic", "dark grey metallic", "meteor grey metallic",
        "agate grey metallic", "graphite grey metallic", "granite grey metallic",
        "Biscay blue", "hurricane grey metallic", "dark graphite metallic",
    ],
    "black": [
        "black", "midnight blue", "dark black", "schwarz", "black metallic", "jet black",
    ],
    "red": [
        "guards red", "red", "rot", "indian red", "coral red", "light red", "signal red",
        "wine red", "carmine red", "ruby red", "bright red", "tomato red", "blood orange red",
    ],
    "blue": [
        "maritime blue", "cobalt blue", "horizon blue", "slate blue", "night blue", "nachtblau",
        "dark blue", "blue", "iris blue", "biscay blue", "polo blue",
    ],
    "blue-metallic": [
        "cobalt blue metallic", "biscay blue metallic", "lapis blue metallic",
        "ocean blue metallic", "dark blue metallic", "minerva blue metallic",
        "azurblau metallic", "riviera blue metallic", "horizon blue metallic",
    ],
    "green": [
        "irish green", "forest green", "olive green", "moss green", "dark olive",
        "meadow green", "green", "light green", "petrol green",
    ],
    "green-metallic": [
        "forest green metallic", "emerald green metallic", "sport green metallic",
        "kelly green metallic", "moss green metallic", "jade green metallic",
        "cassis red metallic",
    ],
    "yellow": [
        "yellow", "speed yellow", "light yellow", "primrose yellow", "cream yellow", "gelb",
        "banana yellow", "racing yellow", "signal yellow", "pastel yellow",
    ],
    "orange": [
        "orange", "light orange", "bahama yellow", "amber", "blood orange", "tangerine",
        "saffron yellow", "copper brown",
    ],
    "brown": [
        "brown", "tobacco", "cognac", "chestnut brown", "oak", "light brown", "havanna",
        "sepia brown",
    ],
    "beige": [
        "beige", "sand beige", "cream", "linen", "chamois", "pastel ivory", "light ivory",
        "satin beige",
    ],
    "gold-metallic": [
        "gold metallic", "champagne metallic", "golden yellow metallic", "aurum",
        "harvest gold metallic",
    ],
    "purple": [
        "purple", "viola", "amethyst", "purple metallic", "dark violet", "orchid",
    ],
    "turquoise": [
        "turquoise", "aqua", "teal", "caribbean blue", "aquamarine", "miami blue", "sky blue",
    ],
    "burgundy": [
        "burgundy", "bordeaux red", "dark red", "wine red", "dark burgundy", "cassis", "maroon",
    ],
    "bronze-metallic": [
        "bronze metallic", "brown metallic", "copper metallic", "rubystone red metallic",
        "mahogany metallic", "dark bronze",
    ],
    "other": [
        "custom", "special", "special order", "unknown", "other", "repaint", "non-standard",
    ],
}

# --- fixed values: model years of each generation, and the hints of the shared years --
GENERATION_YEARS = (
    ("G1", 1965, 1973),
    ("G2", 1974, 1977),
    ("G3", 1978, 1983),
    ("G4", 1984, 1988),
    ("G5", 1990, 1993),
    ("G6", 1995, 1998),
)
# year -> (earlier generation, later generation, words that mean the later one)
SHARED_YEARS = {
    1989: ("G4", "G5", ("964", "carrera 2", "carrera 4", "c2", "c4", "tiptronic")),
    1994: ("G5", "G6", ("993",)),
}

# --- fixed values: patterns of body style and transmission, first match wins ----------
BODY_STYLE_PATTERNS = (
    (r"\bspeedster\b", "speedster"),
    (r"\b(cabriolet|cabrio|convertible|roadster)\b", "cabriolet"),
    (r"\btarga\b", "targa"),
    (r"\b(coupe|coupé)\b", "coupe"),
)
TRANSMISSION_PATTERNS = (
    (r"\btiptronic\b", "auto"),
    (r"\b6[-\s]?speed\b", "manual-6sp"),
    (r"\b(5[-\s]?speed|g50|915|manual|stick|getrag)\b", "manual"),
)

# --- fixed values: three-valued text flags --------------------------------------------
FLAG_PATTERNS = {
    "matching_numbers": {
        "yes": (
            r"\bmatching[- ]numbers?\b",
            r"\bnumbers?[- ]matching\b",
            r"\boriginal[- ]engine\b",
            r"\boriginal[- ]motor\b",
            r"\bfactory[- ]engine\b",
        ),
        "no": (
            r"\bnon[- ]matching\b",
            r"\bengine[- ](swap|replacement|rebuild|replaced)\b",
            r"\b(replacement|rebuilt|swapped)[- ]engine\b",
        ),
    },
    "original_paint": {
        "yes": (
            r"\boriginal[- ]paint\b",
            r"\bunrestored\b",
            r"\bbarn[- ]find\b",
            r"\bfactory[- ](?:original[- ])?paint\b",
            r"\boriginal[- ](?:factory[- ])?finish\b",
            r"\bpaint[- ]meter\b",
        ),
        "no": (
            r"\brepaint(?:ed)?\b",
            r"\bre[- ]paint(?:ed)?\b",
            r"\bnew[- ]paint\b",
            r"\bcolor[- ]change\b",
            r"\brefin(?:ish|ished)\b",
        ),
    },
    "service_history": {
        "yes": (
            r"\bservice[- ]record[s]?\b",
            r"\bservice[- ]histor(?:y|ies)\b",
            r"\bdealer[- ]maintained\b",
            r"\bdocumented[- ](?:service[- ])?histor(?:y|ies)\b",
            r"\bmaintenance[- ]record[s]?\b",
            r"\brecords[- ]present\b",
            r"\brecords[- ]available\b",
            r"\brecords[- ]on[- ]file\b",
            r"\boriginal[- ]books?\b",
        ),
        "no": (
            r"\bno[- ]service[- ]record[s]?\b",
            r"\bno[- ]records?\b",
            r"\brecords?[- ](not[- ]available|unavailable|unknown|missing)\b",
        ),
    },
}

# --- fixed values: modification flags -------------------------------------------------
MODIFICATION_PATTERNS = {
    "widebody": (r"\bwidebody\b", r"\bwide[- ]body\b", r"\bflared?\b"),
    "engine_swap": (
        r"\bengine[- ](swap|replaced|conversion)\b",
        r"\b(993|964|3\.8|3\.6|3\.2)[- ]swap\b",
    ),
    "turbo_conversion": (r"\bturbo[- ]conversion\b", r"\bturbo[- ]kit\b"),
    "aftermarket_exhaust": (
        r"\baftermarket[- ]exhaust\b",
        r"\bsport[- ]exhaust\b",
        r"\b(borla|akrapovic|dansk)\b",
    ),
    "aftermarket_wheels": (
        r"\baftermarket\b.{0,20}\bwheels?\b",
        r"\bnon[- ]factory[- ]wheels?\b",
        r"\b(bbs|fuchs|forgeline|volk|enkei|rotiform)\b",
    ),
    "suspension_mods": (
        r"\blowered\b",
        r"\bcoilover[s]?\b",
        r"\bsuspension[- ](kit|upgrade)\b",
    ),
    "roll_cage": (r"\broll[- ]cage\b", r"\brollcage\b"),
    "stripped_interior": (
        r"\bstripped[- ]interior\b",
        r"\bcage[d]?\b",
        r"\btrack[- ]prep\b",
    ),
}

# --- fixed values: per pattern, whole words one of which is in every match -------------
GATE_WORDS = {
    r"\bmatching[- ]numbers?\b": ("matching",),
    r"\bnumbers?[- ]matching\b": ("matching",),
    r"\boriginal[- ]engine\b": ("engine",),
    r"\boriginal[- ]motor\b": ("motor",),
    r"\bfactory[- ]engine\b": ("engine",),
    r"\bnon[- ]matching\b": ("matching",),
    r"\bengine[- ](swap|replacement|rebuild|replaced)\b": ("engine",),
    r"\b(replacement|rebuilt|swapped)[- ]engine\b": ("engine",),
    r"\boriginal[- ]paint\b": ("paint",),
    r"\bunrestored\b": ("unrestored",),
    r"\bbarn[- ]find\b": ("barn",),
    r"\bfactory[- ](?:original[- ])?paint\b": ("paint",),
    r"\boriginal[- ](?:factory[- ])?finish\b": ("finish",),
    r"\bpaint[- ]meter\b": ("paint",),
    r"\brepaint(?:ed)?\b": ("repaint", "repainted"),
    r"\bre[- ]paint(?:ed)?\b": ("paint", "painted"),
    r"\bnew[- ]paint\b": ("paint",),
    r"\bcolor[- ]change\b": ("color",),
    r"\brefin(?:ish|ished)\b": ("refinish", "refinished"),
    r"\bservice[- ]record[s]?\b": ("service",),
    r"\bservice[- ]histor(?:y|ies)\b": ("service",),
    r"\bdealer[- ]maintained\b": ("maintained",),
    r"\bdocumented[- ](?:service[- ])?histor(?:y|ies)\b": ("documented",),
    r"\bmaintenance[- ]record[s]?\b": ("maintenance",),
    r"\brecords[- ]present\b": ("records",),
    r"\brecords[- ]available\b": ("records",),
    r"\brecords[- ]on[- ]file\b": ("records",),
    r"\boriginal[- ]books?\b": ("book", "books"),
    r"\bno[- ]service[- ]record[s]?\b": ("service",),
    r"\bno[- ]records?\b": ("record", "records"),
    r"\brecords?[- ](not[- ]available|unavailable|unknown|missing)\b": ("record", "records"),
    r"\bwidebody\b": ("widebody",),
    r"\bwide[- ]body\b": ("wide",),
    r"\bflared?\b": ("flare", "flared"),
    r"\bengine[- ](swap|replaced|conversion)\b": ("engine",),
    r"\b(993|964|3\.8|3\.6|3\.2)[- ]swap\b": ("swap",),
    r"\bturbo[- ]conversion\b": ("turbo",),
    r"\bturbo[- ]kit\b": ("turbo",),
    r"\baftermarket[- ]exhaust\b": ("exhaust",),
    r"\bsport[- ]exhaust\b": ("exhaust",),
    r"\b(borla|akrapovic|dansk)\b": ("borla", "akrapovic", "dansk"),
    r"\baftermarket\b.{0,20}\bwheels?\b": ("aftermarket",),
    r"\bnon[- ]factory[- ]wheels?\b": ("wheel", "wheels"),
    r"\b(bbs|fuchs|forgeline|volk|enkei|rotiform)\b": ("bbs", "fuchs", "forgeline", "volk", "enkei", "rotiform"),
    r"\blowered\b": ("lowered",),
    r"\bcoilover[s]?\b": ("coilover", "coilovers"),
    r"\bsuspension[- ](kit|upgrade)\b": ("suspension",),
    r"\broll[- ]cage\b": ("cage",),
    r"\brollcage\b": ("rollcage",),
    r"\bstripped[- ]interior\b": ("interior",),
    r"\bcage[d]?\b": ("cage", "caged"),
    r"\btrack[- ]prep\b": ("prep",),
}
