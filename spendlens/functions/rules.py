"""The rule tables: ordered patterns, word lists and registries. All are fixed values that results depend on."""

from __future__ import annotations

# Categories of uploaded statement lines; the first pattern that matches counts.
UPLOAD_RULES = [
    (r"netflix|spotify|disney[\s+]|hbo|amazon prime|apple tv|youtube premium|paramount|star\+|tidal|deezer", "Streaming"),
    (r"supermercado|disco|devoto|g[eé]ant|tienda inglesa|walmart|ta-ta|ta ta|multiahorro|el dorado", "Supermercado"),
    (r"ute\b|antel|ancap|osse|saneamiento|abl\b|agua|luz\b|gas\b", "Servicios"),
    (r"uber|cabify|bolt|taxi|cut[cs]a|omnibus|bus\b|peaje|acv\b", "Transporte"),
    (r"farmacia|m[eé]dica|hospital|cl[ií]nica|doctor|mutualista|fonasa|smi\b|cam\b", "Salud"),
    (r"restaurant|delivery|pedidosya|rappi|pizza|burger|mcdonald|kfc|burger king|sushi|grill", "Restaurantes"),
    (r"gym|gimnasio|smart ?fit|megatlon|bodytech", "Deporte"),
    (r"cine|teatro|cinema|entretenimiento", "Entretenimiento"),
    (r"salario|sueldo|haberes|remuneraci[oó]n", "Salario"),
    (r"transfer|dep[oó]sito|ingreso", "Transferencia"),
    (r"alquiler|arrendamiento|renta\b", "Vivienda"),
    (r"cuota|pr[eé]stamo|hipoteca|cr[eé]dito", "Préstamos"),
    (r"ropa|zapatillas|calzado|vestuario|zara|h&m|koaj", "Ropa"),
    (r"educaci[oó]n|colegio|universidad|curso|capacitaci[oó]n", "Educación"),
    (r"seguro|p[oó]liza", "Seguros"),
]
# Categories of entries typed by hand.
MANUAL_RULES = [
    (r"netflix|spotify|disney|hbo|amazon prime|youtube premium", "Streaming"),
    (r"supermercado|disco|devoto|geant|tienda inglesa|walmart", "Supermercado"),
    (r"ute|antel|ancap|osse|saneamiento", "Servicios"),
    (r"uber|cabify|bolt|taxi|bus|cutcsa|omnibus", "Transporte"),
    (r"farmacia|medica|hospital|clinica|doctor", "Salud"),
    (r"restaurant|delivery|pedidosya|rappi|pizza|burger", "Comida"),
    (r"gym|gimnasio|sport|fitness", "Deporte"),
    (r"cine|teatro|entretenimiento|juego", "Entretenimiento"),
    (r"salario|sueldo|pago|deposito", "Ingreso"),
]
OTHER_CATEGORY = "Otros"
SAVINGS_CATEGORY = "Ahorro"

# Known merchants of subscriptions: pattern, name, category; the first that matches counts.
MERCHANTS = [
    (r"netflix", "Netflix", "Streaming"),
    (r"spotify", "Spotify", "Streaming"),
    (r"disney[\s+]?plus|disney\+|disneyplus", "Disney+", "Streaming"),
    (r"\bhbo\b|hbomax|max\.com", "HBO Max", "Streaming"),
    (r"amazon prime|prime video|amzn", "Amazon Prime", "Streaming"),
    (r"apple tv|appletv", "Apple TV+", "Streaming"),
    (r"youtube premium|ytpremium", "YouTube Premium", "Streaming"),
    (r"paramount", "Paramount+", "Streaming"),
    (r"star\+|star plus|starplus", "Star+", "Streaming"),
    (r"crunchyroll", "Crunchyroll", "Streaming"),
    (r"mubi", "MUBI", "Streaming"),
    (r"flow\s*digital|cableflow|flow\.com", "Flow", "Streaming"),
    (r"apple music", "Apple Music", "Música"),
    (r"tidal", "Tidal", "Música"),
    (r"deezer", "Deezer", "Música"),
    (r"icloud", "iCloud", "Almacenamiento"),
    (r"google one|google drive", "Google One", "Almacenamiento"),
    (r"dropbox", "Dropbox", "Almacenamiento"),
    (r"microsoft 365|office 365|microsoft office|msoffice", "Microsoft 365", "Software"),
    (r"adobe", "Adobe Creative Cloud", "Software"),
    (r"canva", "Canva", "Software"),
    (r"notion", "Notion", "Software"),
    (r"chatgpt|openai", "ChatGPT Plus", "Software"),
    (r"playstation|ps plus|psn", "PlayStation Plus", "Juegos"),
    (r"xbox|game pass", "Xbox Game Pass", "Juegos"),
    (r"nintendo", "Nintendo Switch Online", "Juegos"),
    (r"ea play|origin", "EA Play", "Juegos"),
    (r"steam", "Steam", "Juegos"),
    (r"gym|gimnasio|smart[\s-]?fit|smartfit|fitmix|bodytech", "Gimnasio", "Salud"),
    (r"meditacion|headspace|calm\b", "Calm / Headspace", "Salud"),
    (r"pedidosya|pedidos[\s]?ya", "PedidosYa+", "Comida"),
    (r"rappi\s*prime|rappi\s*pass", "Rappi Prime", "Comida"),
    (r"new york times|nytimes", "NY Times", "Noticias"),
    (r"the economist", "The Economist", "Noticias"),
    (r"\bantel\b", "Antel", "Servicios"),
    (r"\bclaro\b", "Claro", "Servicios"),
    (r"\bmovistar\b", "Movistar", "Servicios"),
]

# Words that searches leave out, of basket items and of price searches.
BASKET_STOP_WORDS = "de con para el la los las un una en y o al del sin por su".split()
SEARCH_STOP_WORDS = "de con para el la los las un una en y o al".split()

# Other words for a token of a search.
SYNONYMS = {
    "gaseosa": ["refresco"], "refresco": ["gaseosa"], "papa": ["papas"], "papas": ["papa"], "palta": ["aguacate"], "aguacate": ["palta"],
    "pancho": ["salchicha", "salchichas"], "salchicha": ["pancho", "salchichas"], "bidon": ["botellon"], "botellon": ["bidon"],
    "fideos": ["pasta", "pastas"], "pasta": ["fideos"], "detergente": ["lavavajilla", "lavavajillas"], "panal": ["panales"], "panales": ["panal"],
    "yerba": ["yerba mate"], "choclo": ["maiz"], "maiz": ["choclo"], "durazno": ["duraznos", "melocoton"], "arveja": ["arvejas", "guisantes"],
}

# What banks write around a merchant's name.
BANK_PHRASES = [
    "COMPRA CON TARJETA (DEBITO|CREDITO)", "DEBITO A CONFIRMAR", "BANRED COMPRA", "PAGO DE SERVICIO POR BANRED", "DEBITO OPERACION EN SUPERNET O SMS",
    "PAGO ELECTRONICO TARJETA CREDITO", "TRANSF INSTANTANEA (RECIBIDA|ENVIADA)", "TARJETA DEBITO", "COMPRA CON", "SERVICIO DE PAGOS BANRED,?", "RETIRO CORRESPONSALES,?",
]

# Products offered while typing, in order; a few occur twice.
PRODUCTS = [
    "leche", "leche descremada", "leche en polvo", "leche condensada", "leche chocolatada", "yogur", "yogur bebible", "queso", "queso muzzarella", "queso magro",
    "queso rallado", "manteca", "crema de leche", "dulce de leche", "ricota", "huevos", "arroz", "arroz integral", "fideos", "pasta", "polenta", "harina",
    "harina leudante", "azucar", "sal", "aceite", "aceite de girasol", "aceite de oliva", "vinagre", "pure de tomate", "salsa de tomate", "atun", "lentejas", "porotos",
    "garbanzos", "arvejas", "choclo", "mayonesa", "ketchup", "mostaza", "caldo", "pan rallado", "cafe", "te", "yerba", "mate cocido", "cacao", "mermelada", "miel",
    "galletas", "galletas de agua", "galletitas dulces", "cereales", "avena", "tostadas", "pan", "pan de molde", "medialunas", "bizcochos", "chocolate", "alfajor",
    "caramelos", "chicles", "papas fritas", "palitos", "turron", "agua", "agua con gas", "agua sin gas", "refresco", "gaseosa", "jugo", "jugo en polvo", "cerveza",
    "vino", "energizante", "agua tonica", "carne", "carne picada", "pollo", "milanesas", "hamburguesas", "salchichas", "chorizo", "jamon", "jamon cocido", "mortadela",
    "panceta", "bondiola", "pescado", "merluza", "banana", "manzana", "naranja", "mandarina", "limon", "frutilla", "pera", "uva", "tomate", "papa", "cebolla",
    "zanahoria", "lechuga", "morron", "zapallo", "boniato", "ajo", "palta", "pepino", "apio", "espinaca", "brocoli", "helado", "verduras congeladas",
    "medallones de pollo", "papas congeladas", "detergente", "lavandina", "jabon liquido", "jabon en polvo", "suavizante", "limpiador", "desinfectante", "esponja",
    "papel higienico", "rollo de cocina", "servilletas", "bolsas de residuo", "lustramuebles", "limpiavidrios", "shampoo", "acondicionador", "jabon", "jabon de tocador",
    "pasta dental", "cepillo de dientes", "desodorante", "papel higienico", "toallitas", "algodon", "hisopos", "afeitadora", "crema de enjuague", "protector solar",
    "crema corporal", "paracetamol", "ibuprofeno", "alcohol", "alcohol en gel", "curitas", "gasas", "termometro", "protector labial", "repelente", "panales",
    "toallitas humedas", "leche de formula", "shampoo para bebe", "alimento para perros", "alimento para gatos", "arena para gatos",
]

# Store categories (id, label) and, by number of a store, the categories it sells.
STORE_CATEGORIES = [("supermercado", "Supermercado"), ("farmacia", "Farmacia"), ("belleza", "Belleza"), ("ropa", "Ropa")]
STORE_KINDS = [["supermercado"]] * 6 + [["farmacia", "belleza"]] * 2 + [["farmacia"], ["belleza"], ["ropa"], ["ropa"]]

# Events that grant and that revoke the paid plan.
GRANTS = ["INITIAL_PURCHASE", "RENEWAL", "TRIAL_STARTED", "UNCANCELLATION", "PRODUCT_CHANGE", "TRANSFER"]
REVOKES = ["EXPIRATION", "CANCELLATION", "SUBSCRIBER_ALIAS"]
