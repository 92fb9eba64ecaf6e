"""Values that results depend on, stated plainly."""

# Patterns of boilerplate, matched on lower-cased text.
BOILERPLATE_BASE = [
    r"all rights reserved",
    r"copyright \d{4}",
    r"methods?\s+were\s+performed",
    r"data\s+(are|is)\s+available",
    r"statistical\s+analysis",
    r"p\s*[<>=]\s*0\.\d+",
    r"mean\s*[±+]\s*\w+",
    r"(figure|table|fig\.?|tab\.?)\s*\d+",
]
BOILERPLATE_ENHANCED = [
    r"all\s+rights\s+reserved",
    r"copyright\s+\d{4}",
    r"licensed\s+under",
    r"creative\s+commons",
    r"methods?\s+were\s+performed",
    r"data\s+(?:are|is|was|were)\s+available",
    r"statistical(?:ly)?\s+(?:significant|analysis)",
    r"p\s*[<>=≤≥]\s*0\.\d+",
    r"mean\s*[±+]\s*(?:SD|SEM|se)",
    r"(?:figure|table|fig\.?|tab\.?)\s*\d+",
    r"supplementary\s+(?:figure|table|material)",
    r"we\s+(?:used|performed|conducted|analyzed)",
    r"patients?\s+(?:were|was)\s+(?:enrolled|recruited|included)",
]
COMMON_PHRASES = [
    r"in\s+this\s+study",
    r"the\s+results\s+(?:show|demonstrate|indicate|suggest)",
    r"(?:our|these)\s+(?:results|findings|data)",
    r"was\s+(?:significantly|statistically)",
    r"compared\s+(?:to|with)\s+(?:the\s+)?control",
    r"no\s+significant\s+difference",
    r"p\s*(?:value)?\s*(?:was|=|<|>)",
]
# Citations, matched whatever the case.
CITATIONS = [
    r"\(\s*\d{4}\s*\)",
    r"\(\s*[A-Z][a-z]+\s+et\s+al\.?,?\s*\d{4}\s*\)",
    r"\[\s*\d+\s*\]",
    r"\[\s*\d+\s*[-,]\s*\d+\s*\]",
    r"\bet\s+al\.?\b",
    r"\baccording\s+to\b",
    r"\bas\s+(?:shown|demonstrated|reported|described)\s+(?:by|in)\b",
    r"\bprevious(?:ly)?\s+(?:shown|demonstrated|reported)\b",
    r"\b(?:cited|reported)\s+(?:by|in)\b",
]
# Phrases that count as signs of machine-written prose.
AI_PHRASES = [
    "it's important to note", "it is worth noting", "in conclusion", "to summarize", "as mentioned earlier", "it should be noted",
    "furthermore", "moreover", "in this context", "it is essential", "plays a crucial role", "significant impact",
    "comprehensive analysis", "in-depth understanding", "leveraging", "utilizing", "implementing", "facilitating", "encompassing", "streamlining",
]
FILLER_PHRASES = [
    "in order to", "due to the fact that", "it is clear that", "there is no doubt that", "it goes without saying", "needless to say",
    "as a matter of fact", "for the purpose of", "in the event that", "at the present time",
]
# Groups of categories, in order of priority.
GROUPS = [
    ("core_molecular_biology", "Core Molecular Biology", ["biochemistry", "molecular biology", "cell biology", "genetics", "genomics"]),
    ("cancer_oncology", "Cancer & Oncology", ["cancer biology", "oncology", "hematology", "pathology"]),
    ("immunology_infectious", "Immunology & Infectious Disease", ["immunology", "allergy and immunology", "infectious diseases", "hiv/aids", "microbiology"]),
    ("neuroscience_psychiatry", "Neuroscience & Psychiatry", ["neuroscience", "neurology", "psychiatry and clinical psychology", "pain medicine"]),
    ("cardiovascular_respiratory", "Cardiovascular & Respiratory", ["cardiovascular medicine", "respiratory medicine", "physiology"]),
    ("computational_biology", "Computational Biology", ["bioinformatics", "systems biology", "synthetic biology", "bioengineering", "health informatics"]),
    ("genetics_genomic_medicine", "Genetics & Genomic Medicine", ["genetic and genomic medicine", "developmental biology", "biophysics"]),
    ("internal_medicine", "Internal Medicine", ["gastroenterology", "endocrinology", "nephrology", "rheumatology"]),
    ("surgery_specialties", "Surgery & Specialties", ["surgery", "orthopedics", "ophthalmology", "otolaryngology", "urology", "dermatology", "transplantation", "dentistry and oral medicine"]),
    ("womens_childrens_health", "Women's & Children's Health", ["obstetrics and gynecology", "pediatrics", "geriatric medicine"]),
    ("public_health", "Public Health", ["epidemiology", "public and global health", "occupational and environmental health", "nutrition", "clinical trials"]),
    ("pharmacology", "Pharmacology", ["pharmacology and toxicology", "pharmacology and therapeutics", "toxicology", "addiction medicine"]),
    ("emergency_critical_care", "Emergency & Critical Care", ["emergency medicine", "intensive care and critical care medicine", "anesthesia", "palliative medicine"]),
    ("health_systems", "Health Systems", ["health economics", "health policy", "health systems and quality improvement", "medical education", "medical ethics", "primary care research", "nursing", "forensic medicine"]),
    ("ecology_evolution", "Ecology & Evolution", ["ecology", "evolutionary biology", "animal behavior and cognition", "zoology", "plant biology", "paleontology", "scientific communication and education"]),
    ("other_specialties", "Other Specialties", ["radiology and imaging", "rehabilitation medicine and physical therapy", "sports medicine"]),
]
DEFAULT_GROUP = "other_specialties"
# Code points that cleaning deletes.
INVISIBLE = "​‌‍‎‏⁠﻿­‪‫‬‭‮"
EXCLUDED_SECTION_WORDS = [
    "reference", "bibliography", "author", "affiliation", "contribution", "acknowledge", "funding", "conflict",
    "competing", "copyright", "data_availability", "supplementary", "appendix", "ethics",
]
