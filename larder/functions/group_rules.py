"""Rules that give a product its group."""

# Fixed values: (group, product form, patterns that must all be found, patterns none of which may be), in order; the first rule that fits decides.
GROUP_RULES = (
    ("milk-whole-1l", "raw", (r"\b(milch|milk|vollmilch|halbfettmilch)\b",), ("schoko", "kokos", "mandel", "hafer", "soja", "reis", "drink", "pudding", "dessert", "glace", "shake", "caramel", "branche", "pralin", "kägi", "alpes")),
    ("milk-plant", "processed", (r"(hafermilch|haferdrink|mandelmilch|sojamilch|reismilch|sojadrink|oat\s*milk)",), ()),
    ("yogurt-plain", "raw", (r"\b(joghurt|jogurt|yoghurt)\b",), ("twix", "mars", "snickers", "riegel", "schokolade")),
    ("butter-250g", "raw", (r"\b(butter|bratbutter|vorzugsbutter)\b",), ("guezli", "gipfel", "erdnuss", "cookie", "schokolade", "croissant", "cordon")),
    ("gruyere", "raw", (r"\b(gruyère|gruyere)\b",), ("fondue",)),
    ("emmentaler", "raw", (r"\bemmentaler\b",), ("fondue",)),
    ("appenzeller", "raw", (r"\bappenzeller\b",), ("fondue", "bärli", "biber")),
    ("cheese-hard", "raw", (r"\b(käse|reibkäse)\b",), ("schnitzel", "cordon", "fondue", "gruyère", "gruyere", "emmentaler", "appenzeller")),
    ("mozzarella", "raw", (r"\b(mozzarella|burrata)\b",), ("schnitzel", "pizza", "panini")),
    ("feta", "raw", (r"\bfeta\b",), ()),
    ("cream", "raw", (r"\b(rahm|sahne|halbrahm|vollrahm)\b",), ("glace", "eis")),
    ("quark", "raw", (r"\bquark\b",), ()),
    ("eggs-6pack", "raw", (r"\beier\b",), ("nudeln", "hörnli", "penne", "magronen", "spaghetti", "teigwaren", "pasta")),
    ("chicken-wings", "raw", (r"(pouletflügeli|pouletflügel|chicken\s*wings|poulet\s*flügeli)",), ()),
    ("chicken-thigh", "raw", (r"(pouletschenkel|poulet\s*schenkel|oberschenkel)",), ()),
    ("chicken-nuggets", "ready-meal", (r"(poulet\s*nuggets|chicken\s*nuggets|poulet\s*knusperli|poulet\s*crispy)",), ()),
    ("chicken-whole", "raw", (r"(poulet\s*ganz|ganzes\s*poulet|bratpoulet)",), ()),
    ("chicken-breast", "raw", (r"(pouletbrust|pouletschnitzel|pouletbrustfilet|poulet\s*brust)",), ("flügeli", "wings", "schenkel", "nuggets")),
    ("beef-minced", "raw", ("(hackfleisch|rindshackfleisch|rindshack)",), ("burger", "bällchen", "bolognese")),
    ("pork-schnitzel", "raw", ("(schweineschnitzel|schnitzel)",), ("poulet", "cordon")),
    ("salami", "processed", (r"\b(salami|salametti)\b",), ()),
    ("ham", "processed", (r"\b(schinken|hinterschinken|kochschinken)\b",), ()),
    ("sausage", "processed", (r"\b(cervelat|bratwurst|wienerli)\b",), ()),
    ("salmon-smoked", "processed", (r"(räucherlachs|lachs\s*geräuchert|smoked\s*salmon)",), ()),
    ("salmon", "raw", (r"\b(lachs|salmon)\b",), ("räucher", "geräuchert", "smoked")),
    ("shrimp", "raw", (r"\b(crevetten|shrimp|garnelen)\b",), ()),
    ("zopf", "raw", (r"\b(zopf|butterzopf)\b",), ()),
    ("naan-bread", "raw", (r"\bnaan\b",), ()),
    ("bread-assorted", "raw", (r"\b(brot|ruchbrot|toast|toastbrot)\b",), ("aufstrich", "chips", "stängel", "crouton")),
    ("tomato-puree", "processed", ("(tomatenpüree|tomatenpuree|tomatenmark|tomatenkonzentrat)",), ()),
    ("tomato-sauce", "processed", ("(tomatensauce|tomatensugo|passata|sugo)",), ("pizza",)),
    ("tomatoes-canned", "canned", (r"\b(pelati|tomatenstücke|tomatenstucke|geschälte\s*tomaten)\b",), ()),
    ("tomatoes-fresh", "raw", (r"\b(tomaten|cherry|rispentomaten)\b",), ("püree", "puree", "sauce", "mark", "ketchup", "sugo", "passata", "pelati", "getrocknet", "stücke", "konzentrat", "paste")),
    ("potato-ready-meal", "ready-meal", ("(kartoffel.*(cubes|gratin|stock|püree|smoky|country)|rösti|kartoffelstock|kartoffelgratin|kartoffelpüree)",), ()),
    ("fries-frozen", "frozen", (r"(pommes\s*frites|kartoffel\s*frites|wedges|frites)",), ()),
    ("potatoes", "raw", (r"\b(kartoffel|kartoffeln)\b",), ("cubes", "gratin", "rösti", "stock", "püree", "chips", "frites", "wedges", "kroketten", "gnocchi", "smoky", "country")),
    ("onions", "raw", (r"\bzwiebeln?\b",), ()),
    ("garlic", "raw", (r"\b(knoblauch|knoblauchzehen)\b",), ("spiess", "crevette", "poulet", "wurst", "pizza", "brot", "butter")),
    ("ginger", "raw", (r"\bingwer\b",), ()),
    ("spinach", "raw", (r"\b(spinat|blattspinat)\b",), ("tortelloni", "ravioli", "pizza", "quiche", "lasagne", "cannelloni")),
    ("bell-peppers", "raw", (r"\bpeperoni\b",), ()),
    ("zucchini", "raw", (r"\b(zucchetti|zucchini)\b",), ()),
    ("eggplant", "raw", (r"\b(aubergine|auberginen)\b",), ()),
    ("cucumber", "raw", (r"\b(gurke|gurken|salatgurke)\b",), ()),
    ("carrots", "raw", (r"\b(karotten|rüebli)\b",), ()),
    ("mushrooms", "raw", (r"\b(champignons|pilze)\b",), ()),
    ("salad-greens", "raw", (r"\b(eisberg|rucola|nüsslisalat|kopfsalat)\b",), ("dressing", "sauce")),
    ("bananas", "raw", (r"\bbananen?\b",), ("chips",)),
    ("apples", "raw", (r"\b(äpfel|apfel|gala|braeburn)\b",), ("saft", "schorle", "essig", "mus")),
    ("strawberries", "raw", (r"\berdbeeren?\b",), ("konfitüre", "marmelade", "joghurt", "müesli", "drink", "actimel", "lc1", "glacé", "glace", "sirup", "cornet")),
    ("blueberries", "raw", (r"\bheidelbeeren?\b",), ("konfitüre", "marmelade", "joghurt", "müesli", "drink", "sirup")),
    ("raspberries", "raw", (r"\bhimbeeren?\b",), ("konfitüre", "marmelade", "joghurt", "müesli", "drink", "sirup")),
    ("berries", "raw", (r"\bbeeren\b",), ("konfitüre", "marmelade", "joghurt", "müesli", "erdbeeren", "himbeeren", "heidelbeeren", "preiselbeeren")),
    ("hummus", "ready-meal", (r"\bhummus\b",), ()),
    ("tofu", "raw", (r"\btofu\b",), ()),
    ("pasta-assorted", "dried", (r"\b(spaghetti|penne|fusilli|rigatoni|farfalle|tagliatelle)\b",), ("sauce", "fertig")),
    ("rice-assorted", "dried", (r"\b(reis|basmati|jasmin)\b",), ("milch", "drink", r"risotto\s*fertig")),
    ("coconut-milk", "canned", (r"\b(kokosmilch|kokosnussmilch|coconut\s*milk)\b",), ()),
    ("lentils", "canned", (r"\blinsen\b",), ()),
    ("chickpeas", "canned", (r"\bkichererbsen\b",), ()),
    ("olives", "canned", (r"\boliven\b",), ("öl",)),
    ("tuna-canned", "canned", (r"\bthunfisch\b",), ("frisch", "steak")),
    ("beans-canned", "canned", (r"\b(kidneybohnen|bohnen)\b",), ("kaffee",)),
    ("olive-oil", "processed", (r"\bolivenöl\b",), ("piadina", "brot", "pizza")),
    ("cooking-oil", "processed", (r"\b(sonnenblumenöl|rapsöl)\b",), ()),
    ("flour", "dried", (r"\b(mehl|weissmehl|ruchmehl)\b",), ()),
    ("sugar", "processed", (r"\b(zucker|rohrzucker)\b",), ("getränk", "drink")),
    ("coffee-assorted", "processed", (r"\b(kaffee|espresso)\b",), ("rahm", "glace", "sirup")),
    ("tea-assorted", "dried", (r"\btee\b",), ()),
    ("chocolate-assorted", "processed", (r"\b(schokolade|tafelschokolade)\b",), ("milch", "drink", "pudding")),
    ("chips", "processed", (r"\bchips\b",), ("schoko",)),
    ("muesli", "processed", (r"\b(müesli|birchermüesli|müsli|muesli)\b",), ()),
    ("nuts", "raw", (r"\b(nüsse|mandeln|cashew|erdnüsse)\b",), ("butter", "creme", "aufstrich")),
    ("wine-red", "processed", (r"\b(rotwein|primitivo|merlot|cabernet|pinot\s*noir|tempranillo|chianti|rioja|barolo|barbera|amarone|montepulciano|sangiovese)\b",), ("essig",)),
    ("wine-white", "processed", (r"\b(weisswein|chardonnay|sauvignon\s*blanc|riesling|pinot\s*grigio|pinot\s*gris|prosecco|grauburgunder|müller.thurgau|fendant|chasselas|aigle)\b",), ("essig",)),
    ("wine-rose", "processed", (r"\b(rosé|roséwein)\b",), ("essig", "creme", "dusch")),
    ("beer", "processed", (r"\b(bier|lager|pils|feldschlösschen|appenzeller\s*bier|calanda|quöllfrisch|eichhof|cardinal|chopfab)\b",), ("essig", "bierhefe")),
    ("mineral-water", "processed", (r"\b(mineralwasser|henniez|valser|aproz|evian|volvic|contrex)\b",), ()),
    ("juice", "processed", (r"\b(orangensaft|apfelsaft|multivitamin|fruchtsaft|nektar)\b",), ()),
    ("frozen-pizza", "frozen", (r"\b(pizza|tiefkühlpizza|steinofen.?pizza)\b",), ("sauce", "gewürz", r"teig\b")),
    ("laundry-detergent", "processed", (r"\b(waschmittel|waschpulver)\b",), ()),
    ("dish-soap", "processed", (r"\b(abwaschmittel|geschirrspül)\b",), ()),
    ("all-purpose-cleaner", "processed", (r"\b(reiniger|allzweckreiniger|putzmittel)\b",), ()),
    ("toilet-paper", "processed", (r"\b(toilettenpapier|wc-papier)\b",), ()),
    ("paper-towels", "processed", (r"\b(küchenpapier|haushaltpapier)\b",), ()),
    ("shampoo", "processed", (r"\bshampoo\b",), ()),
    ("shower-gel", "processed", (r"\b(duschgel|shower)\b",), ()),
    ("toothpaste", "processed", (r"\b(zahnpasta|zahncreme)\b",), ()),
    ("deodorant", "processed", (r"\b(deo|deodorant)\b",), ()),
)
