"""Default keyword rules of a packaging and hardware catalogue. Rules are data: attribute, method, value, keywords, confidence."""

#: The whole file. Each rule list is in order of priority.
RULES_VERSION = "2026-06-11"
COLORS = (
    "AMARILLO", "AMBAR", "AZUL", "BEIGE", "BLANCO", "CELESTE", "DORADO", "FOSFORESCENTE", "FUCSIA", "GRIS",
    "MARRON", "MORADO", "NARANJA", "NATURAL", "NEGRO", "PLATEADO", "ROJO", "ROSADO", "TRANSPARENTE", "VERDE",
)
#: keyword, material, family
MATERIALS = (
    ("POLICARBONATO", "PC", "POLICARBONATO"),
    ("ACRILICO", "ACRILICO", "ACRILICO"),
    ("ALUMINIO", "ALUMINIO", "METAL"),
    ("CARTON", "CARTON", "PAPEL_CARTON"),
    ("LDPE", "LDPE", "POLIETILENO"),
    ("PEAD", "PEAD", "POLIETILENO"),
    ("PETG", "PETG", "POLIETILENO TEREFTALATO"),
    ("PET", "PET", "POLIETILENO TEREFTALATO"),
    ("PAPEL", "PAPEL", "PAPEL_CARTON"),
    ("METAL", "METAL", "METAL"),
    ("NYLON", "NYLON", "POLIAMIDA"),
    ("PLASTICO", "PLASTICO", "PLASTICO"),
    ("PP", "PP", "POLIPROPILENO"),
    ("PVC", "PVC", "PVC"),
    ("VIDRIO", "VIDRIO", "VIDRIO"),
)
CONFIDENCE = {"color": 0.94, "material": 0.94, "default_use": 0.60}
DEFAULT_USE = "general"
CLOSURES = ("atomizador", "dispensador", "rosca", "chupon", "gatillo")
KEYWORD_RULES = [
    ("product_type", "keyword_first_match", "cremero", ["CREMERO", "VASELINERO"], 0.94),
    ("product_type", "keyword_first_match", "accesorio", ["PASTILLERO"], 0.90),
    ("product_type", "keyword_first_match", "accesorio", ["PISETA", "GRADILLA", "TALQUERA", "PROBETA", "PROPIPETA"], 0.88),
    ("product_type", "keyword_first_match", "gotero", ["GOTERO"], 0.95),
    ("product_type", "keyword_first_match", "pote", ["POTE", "CREMERO"], 0.92),
    ("product_type", "keyword_first_match", "tubo", ["TUBO", "TUBOS"], 0.90),
    ("product_type", "keyword_first_match", "frasco", ["FRASCO", "BOTELLA", "ENVASE"], 0.93),
    ("product_type", "keyword_first_match", "atomizador", ["BOMBA", "ATOMIZADORA", "ATOMIZADOR", "SPRAY", "GATILLO", "PULVERIZADOR", "TRIGGER"], 0.92),
    ("product_type", "keyword_first_match", "tapa", ["TAPA", "TAPON", "VALVULA", "DISPENSADOR", "ATOMIZADOR"], 0.90),
    ("product_type", "keyword_first_match", "bolsa", ["BOLSA", "BOLSAS", "ZIPLOC"], 0.91),
    ("product_type", "keyword_first_match", "caja", ["CAJA", "CAJAS"], 0.90),
    ("product_type", "keyword_first_match", "kit", ["KIT", "SET"], 0.86),
    ("product_type", "keyword_first_match", "etiqueta", ["ETIQUETA", "STICKER"], 0.90),
    ("product_type", "keyword_first_match", "equipo", ["MAQUINA", "EQUIPO", "LAPTOP", "IMPRESORA"], 0.84),
    ("product_type", "keyword_first_match", "accesorio", ["REPUESTO", "ACCESORIO"], 0.84),
    ("subtype", "keyword_first_match", "airless", ["AIRLESS"], 0.96),
    ("subtype", "keyword_first_match", "atomizador", ["ATOMIZADOR", "SPRAY"], 0.95),
    ("subtype", "keyword_first_match", "bullet", ["BULLET"], 0.97),
    ("subtype", "keyword_first_match", "campana", ["CAMPANA"], 0.94),
    ("subtype", "keyword_first_match", "chupon", ["CHUPON"], 0.94),
    ("subtype", "keyword_first_match", "cremero", ["CREMERO"], 0.95),
    ("subtype", "keyword_first_match", "dispensador", ["DISPENSADOR", "DISPENSADORA"], 0.95),
    ("subtype", "keyword_first_match", "espumero", ["ESPUMERO"], 0.97),
    ("subtype", "keyword_first_match", "gatillo", ["GATILLO"], 0.94),
    ("subtype", "keyword_first_match", "laina", ["LAINA"], 0.92),
    ("subtype", "keyword_first_match", "rimel", ["RIMEL"], 0.95),
    ("subtype", "keyword_first_match", "rosca", ["ROSCA"], 0.90),
    ("subtype", "keyword_first_match", "ziploc", ["ZIPLOC"], 0.95),
    ("subtype", "keyword_first_match", "esmalte", ["ESMALTE"], 0.92),
    ("subtype", "keyword_first_match", "lipstick", ["BALSAMO", "LIPSTICK"], 0.90),
    ("subtype", "keyword_first_match", "vial", ["VIAL"], 0.88),
    ("subtype", "keyword_first_match", "dosificador", ["DOSIFICADOR"], 0.86),
    ("accessory", "keyword_any", "brocha", ["BROCHA"], 0.92),
    ("accessory", "keyword_any", "chupon", ["CHUPON"], 0.92),
    ("accessory", "keyword_any", "laina", ["LAINA"], 0.90),
    ("accessory", "keyword_any", "tapa", ["TAPA", "TAPON"], 0.88),
    ("accessory", "keyword_any", "rejilla", ["REJILLA"], 0.88),
    ("accessory", "keyword_any", "gatillo", ["GATILLO", "TRIGGER"], 0.90),
    ("shape", "keyword_first_match", "ovalado", ["OVALADO", "OVALADA"], 0.90),
    ("shape", "keyword_first_match", "conico", ["CONICO", "CONICA"], 0.88),
    ("shape", "keyword_first_match", "tubular", ["TUBULAR"], 0.88),
    ("shape", "keyword_first_match", "cilindrico", ["CILINDRICO", "CILINDRICA"], 0.86),
    ("feature", "keyword_first_match", "no_esteril", ["NO ESTERIL"], 0.88),
    ("feature", "keyword_first_match", "esteril", ["ESTERIL", "ESTERILES"], 0.90),
    ("feature", "keyword_first_match", "graduado", ["GRADUADO", "GRADUADA"], 0.90),
    ("feature", "keyword_first_match", "descartable", ["DESCARTABLE"], 0.88),
    ("feature", "keyword_first_match", "importado", ["IMPORTADO", "IMPORTADA"], 0.80),
    ("use_category", "keyword_first_match", "cosmetica", ["RIMEL", "LIPSTICK", "CREMERO", "COSMET", "BULLET", "AIRLESS"], 0.89),
    ("use_category", "keyword_first_match", "medico_laboratorio", ["ODONTO", "MEDIC", "CLINIC", "ORTOPEDIA", "PH", "CLORO"], 0.84),
    ("use_category", "keyword_first_match", "ferreteria", ["PINTURA", "BROCHA", "TORNILLO", "TUERCA", "MANGUERA"], 0.84),
    ("use_category", "keyword_first_match", "empaque_envase", ["BOLSA", "CAJA", "ENVASE", "FRASCO", "POTE"], 0.82),
]
