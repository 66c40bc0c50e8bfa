"""Fixed values. These must equal the published tables for right results."""

# Residue alphabet in its customary order.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"

# Order of the twenty numbers in a scalar property record, read pairwise.
RECORD_PAIR_ORDER = ["A/L", "R/K", "N/M", "D/F", "C/P", "Q/S", "E/T", "G/W", "H/Y", "I/V"]

# Half-open, zero-based HA1 slice of the alignment.
HA1_START, HA1_END = 16, 345

# Four residue scales, in AMINO_ACIDS order.
SCALES = {
    # Kyte-Doolittle hydrophobicity (KYTJ820101)
    "hydrophobicity": [1.8, -4.5, -3.5, -3.5, 2.5, -3.5, -3.5, -0.4, -3.2, 4.5,
                       3.8, -3.9, 1.9, 2.8, -1.6, -0.8, -0.7, -0.9, -1.3, 4.2],
    # Bigelow residue volume (BIGC670101)
    "volume": [52.6, 109.1, 75.7, 68.4, 68.3, 89.7, 84.7, 36.3, 91.9, 102.0,
               102.0, 105.1, 97.7, 113.9, 73.6, 54.9, 71.2, 135.4, 116.2, 85.1],
    "charge": [0, 1, 0, -1, 0, 0, -1, 0, 0.1, 0,
               0, 1, 0, 0, 0, 0, 0, 0, 0, 0],
    # Zimmerman polarity (ZIMJ680103)
    "polarity": [0.00, 52.00, 3.38, 49.70, 1.48, 3.53, 49.90, 0.00, 51.60, 0.13,
                 0.13, 49.50, 1.43, 0.35, 1.58, 1.67, 1.66, 2.10, 1.61, 0.13],
}

# Sites next to the receptor binding site, 1-based.
KEY_SITES = [145, 155, 156, 158, 159, 189, 193]

# Antibody-binding regions, 1-based sites.
EPITOPES = {
    "A": [133, 137, 140, 141, 142, 143, 144, 145, 146],
    "B": [155, 186, 187, 188, 189, 190, 191, 192, 193, 194, 195, 196],
    "C": [52, 53, 54, 275, 277, 278],
    "D": [201, 205, 207, 217, 220, 226, 242],
    "E": [122, 126],
}

# Six amino-acid groupings; a residue in no class belongs to one further class.
GROUPINGS = {
    1: ["AFGILMPVW", "CNQSTY", "DEHKR"],
    2: ["AGILMV", "FPW", "CNQSTY", "DEHKR"],
    3: ["AFGILMPVW", "CNQSTY", "HKR", "DE"],
    4: ["AGILMV", "FPW", "CNQSTY", "HKR", "DE"],
    5: ["AILMPV", "FWY", "NQST", "HKR", "DE", "C", "G"],
    6: ["AILMPV", "FWY", "NQST", "DEHKR", "C", "G"],
}

# City abbreviations in report headers.
CITY_ABBREVIATIONS = {
    "Chch": "Christchurch",
    "ND": "North Dakota",
    "HK": "Hong Kong",
    "NY": "New York",
    "BW": "Baden-Wurttemburg",
    "NH": "New Hampshire",
    "Jbg": "Johannesburg",
    "Jhb": "Johannesburg",
    "JHB": "Johannesburg",
    "Fin": "Finland",
    "SAust": "South Australia",
}

# The pattern of a strain name, and the titles of the tables that are read.
STRAIN_PATTERN = r"A/[^/\n]+/[A-Za-z0-9\-]+/\d{2,4}"
TABLE_TITLES = (
    "Antigenic analysis of influenza AH3N2 viruses",
    "Antigenic analysis of influenza A(H3N2) viruses",
    "Antigenic analyses of influenza A H3N2 viruses",
    "Antigenic analysis of influenza A H3N2 viruses",
    "Antigenic analyses of influenza A(H3N2) viruses",
)

# Fixed values of the report 2003-dec: the columns of its two pages (counted from 0) and the phrases to drop.
DECEMBER_COLUMNS = {
    11: ["A/Panama/2007/99", "A/New York/55/01", "A/Hong Kong/1550/02", "A/Egypt/130/02", "A/Fujian/411/02", "A/Sendai/4952/02", "A/Finland/170/03"],
    12: ["A/Panama/2007/99", "A/New York/55/01", "A/Egypt/130/02", "A/Fujian/411/02", "A/Finland/170/03", "A/Wyoming/3/03", "A/UK/1861/03"],
}
DECEMBER_PHRASES = ("Haemagglutination inhibition titre1 Post infection ferret sera ", " 1 . <40,<4040", " 1. <40,<4040")

# The strain names of the first report, with two-digit years.
FIRST_STRAIN_PATTERN = r"A/[A-Za-z\-]+/[A-Za-z0-9\-]+/\d{2}"

# What the lists of table heads start with, in order of precedence.
HEADER_STARTS = {
    "first": ("Viruses Isolation",),
    "early": ("Viruses Isolation", "Viruses Collection"),
    "middle": ("Viruses Collection Passage ", "Collection Passage "),
    "plaques": ("Viruses Collection Passage plaques ", "Viruses Collection Passage ", "Collection Passage "),
    "later": ("Viruses Collection Passage plaques ", "Viruses Collection Passage ", "Viruses Other Collection Passage ", "Collection Passage "),
    "latest": ("Viruses Collection Passage plaques ", "Viruses Collection Passage ", "Viruses Other Collection Passage ", "Collection Passage ", "Viruses Other "),
    "dates": ("Date History ",),
    "later dates": ("Date History ", "information date history ", "date history "),
    "latest dates": ("Date History ", "information date history ", "date history ", "information "),
}

# Marks in report text and what they are read as.
REPLACED = {"below": ("<", "<40"), "not done": ("ND", "*"), "not tested": ("NT", "*"), "bar": ("|", "*"), "above": (">", ""), "star": ("*", "")}

# The two forms of a period in a file name.
MONTH_THEN_YEAR = (
    r"(january|february|march|april|june|july|august|september|october|november|december|sept|"
    r"jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[^0-9]{0,5}(\d{4})")
YEAR_THEN_MONTH = r"(\d{4})[^a-z]{0,5}(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
