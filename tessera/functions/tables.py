"""Word lists and maps of the normaliser. Results depend on each of them."""

# fixed values: street types
STREET = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard",
    "ln": "lane", "dr": "drive", "ct": "court", "cir": "circle", "pl": "place", "pkwy": "parkway", "hwy": "highway",
    "sq": "square", "ter": "terrace", "trl": "trail", "cres": "crescent", "mkt": "market", "ngr": "nagar", "clny": "colony",
    "r": "rue", "all": "allee", "imp": "impasse", "ch": "chemin", "rte": "route", "fbg": "faubourg", "crs": "cours",
}
# fixed values: by country, before STREET
STREET_COUNTRY = {"France": {"st": "saint", "ste": "sainte", "sts": "saints", "stes": "saintes"}}
# fixed values: address words without weight
ADDR_STOP = ["de", "du", "des", "la", "le", "les", "l", "d", "n", "no", "nos", "num", "of", "the", "and", "et", "au", "aux", "en"]
# fixed values: words that are no unit codes
UNIT_EXCLUDE = ["n", "no", "nos", "num", "nr", *STREET]
# fixed values: number words
NUMBER_WORDS = {
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8",
    "ninth": "9", "tenth": "10", "eleventh": "11", "twelfth": "12", "thirteenth": "13", "fourteenth": "14", "fifteenth": "15",
    "sixteenth": "16", "seventeenth": "17", "eighteenth": "18", "nineteenth": "19", "twentieth": "20",
    "premier": "1", "premiere": "1", "deuxieme": "2", "troisieme": "3",
}
# fixed values: legal forms
LEGAL = [
    "inc", "incorporated", "llc", "ltd", "limited", "pvt", "private", "public", "corp", "corporation", "co", "company",
    "lp", "llp", "pllc", "pc", "plc", "gmbh", "sarl", "sas", "sasu", "sa", "eurl", "sci", "snc", "ei", "cie", "compagnie",
]
# fixed values: markers between a former and the present name
ALIAS_MARKERS = ["f/k/a", "a/k/a", "d/b/a", "t/a", "fka", "aka", "dba", "formerly", "trading as", "doing business as"]
# fixed values: digits that stand for letters in names
LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
# fixed values: forms of address and function words in names
HONORIFIC = ["the", "mr", "mrs", "ms", "dr", "smt", "shri", "sri", "sree", "shree", "m", "s", "messrs"]
NAME_STOP = ["and", "of", "de", "du", "des", "la", "le", "les", "l", "d", "et", "en", "au", "aux"]
# fixed values: words that are no street names
STREET_DROP = (
    "rue r avenue av ave bd boulevard blvd chemin ch route rte place pl allee all impasse imp quai cours chaussee chau "
    "square sq voie passage residence res lieu dit lotissement lot street st road rd drive dr lane ln court ct way circle cir "
    "trail trl parkway pkwy highway hwy terrace ter pike no nos num n bis unit apt apartment suite ste floor fl flat plot "
    "shop door house h b t de du des la le les l d a au aux en et the of and saint sainte"
).split()

# fixed values: other names of places by country; the canonical word is added
PLACE_ALIAS = {
    "India": {
        "calcutta": "kolkata", "kolkatta": "kolkata", "bombay": "mumbai", "bangalore": "bengaluru", "banglore": "bengaluru",
        "bengalooru": "bengaluru", "madras": "chennai", "gurgaon": "gurugram", "trivandrum": "thiruvananthapuram",
        "calicut": "kozhikode", "trichy": "tiruchirappalli", "tiruchi": "tiruchirappalli", "baroda": "vadodara",
        "vizag": "visakhapatnam", "vishakhapatnam": "visakhapatnam", "poona": "pune", "cochin": "kochi", "ernakulam": "kochi",
        "mysore": "mysuru", "allahabad": "prayagraj", "mangalore": "mangaluru", "belgaum": "belagavi", "gulbarga": "kalaburagi",
        "hubli": "hubballi", "ahmadabad": "ahmedabad", "nasik": "nashik", "kancheepuram": "kanchipuram",
        "tiruvallur": "thiruvallur", "rangareddi": "rangareddy", "paraganas": "parganas", "keralam": "kerala",
        "orissa": "odisha", "secunderabad": "hyderabad", "benaras": "varanasi", "banaras": "varanasi",
        "pondicherry": "puducherry", "simla": "shimla", "tuticorin": "thoothukudi", "cawnpore": "kanpur",
        "trichur": "thrissur", "quilon": "kollam", "alleppey": "alappuzha", "cuddapah": "kadapa", "gauhati": "guwahati",
        "jubbulpore": "jabalpur", "bhubaneshwar": "bhubaneswar",
    }
}
# fixed values: places of several words, one word each
PLACE_PHRASE = {
    "India": [
        (("andhra", "pradesh"), "st_ap_tg"), (("telangana",), "st_ap_tg"), (("telangaan",), "st_ap_tg"), (("aandhrapradesh",), "st_ap_tg"),
        (("madhya", "pradesh"), "st_mp"), (("madhy", "pradesh"), "st_mp"), (("uttar", "pradesh"), "st_up"), (("himachal", "pradesh"), "st_hp"),
        (("arunachal", "pradesh"), "st_ar"), (("west", "bengal"), "st_wb"), (("pashchimabangg",), "st_wb"), (("tamil", "nadu"), "st_tn"),
        (("gautam", "buddha", "nagar"), "noida"), (("ranga", "reddy"), "rangareddy"), (("navi", "mumbai"), "navimumbai"),
        (("new", "bombay"), "navimumbai"), (("chhatrapati", "sambhaji", "nagar"), "aurangabad"), (("sawai", "madhopur"), "sawaimadhopur"),
        (("new", "delhi"), "delhi"),
    ]
}
# fixed values: words that stand for nothing else where places are handled, and filler words of addresses
PLACE_SYN_BLOCK = [
    "pradesh", "west", "east", "north", "south", "bengal", "nadu", "tamil", "uttar", "madhya", "andhra",
    "himachal", "arunachal", "w", "e", "n", "s",
]
PLACE_ADDR_STOP = ["door", "dor", "doro", "null"]

# fixed values: sounds of the Brahmic blocks by offset
VOWELS = {5: "a", 6: "aa", 7: "i", 8: "ii", 9: "u", 10: "uu", 11: "ri", 12: "li", 13: "e", 14: "e", 15: "e", 16: "ai", 17: "o", 18: "o", 19: "o", 20: "au", 96: "rri", 97: "lli"}
CONSONANTS = dict(zip(range(21, 58), "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split())) | dict(zip(range(88, 96), "q kh gh z r rh f y".split()))
MATRAS = {62: "aa", 63: "i", 64: "ii", 65: "u", 66: "uu", 67: "ri", 68: "rri", 69: "e", 70: "e", 71: "e", 72: "ai", 73: "o", 74: "o", 75: "o", 76: "au", 98: "li", 99: "lli"}
SIGNS = {1: "n", 2: "n", 3: "h"}
VIRAMA, NUKTA = 77, 60
