"""Words and letters of mixed Bengali and English questions, and shorthand.

Everything in this module is a fixed value: it states what the compatible
results need and holds no logic.
"""

# --- English words in Bengali letters.
LOANWORDS = {
    "প্রাইস": "price", "প্রাইজ": "price", "কস্ট": "cost", "রেট": "rate", "অফার": "offer", "ডিসকাউন্ট": "discount", "সেল": "sale", "ফ্রি": "free",
    "চার্জ": "charge", "পেমেন্ট": "payment", "ক্যাশ": "cash", "অনলাইন": "online", "সাইজ": "size", "ফিট": "fit", "স্মল": "small", "মিডিয়াম": "medium",
    "লার্জ": "large", "এক্সএল": "XL", "এক্সএক্সএল": "XXL", "কালার": "color", "ডিজাইন": "design", "কোয়ালিটি": "quality", "অরিজিনাল": "original",
    "কপি": "copy", "ব্র্যান্ড": "brand", "প্রোডাক্ট": "product", "আইটেম": "item", "স্টক": "stock", "অ্যাভেইলেবল": "available", "ডেলিভারি": "delivery",
    "শিপিং": "shipping", "রিটার্ন": "return", "এক্সচেঞ্জ": "exchange", "ওয়ারেন্টি": "warranty", "টিশার্ট": "tshirt", "শার্ট": "shirt",
    "প্যান্ট": "pant", "জ্যাকেট": "jacket", "হুডি": "hoodie", "সোয়েটার": "sweater", "ড্রেস": "dress", "লেগিংস": "leggings", "জিন্স": "jeans",
    "শর্টস": "shorts", "স্নিকার": "sneaker", "স্যান্ডেল": "sandal", "ব্যাগ": "bag", "ব্যাকপ্যাক": "backpack", "ওয়ালেট": "wallet", "বেল্ট": "belt",
    "স্কার্ফ": "scarf", "সানগ্লাস": "sunglasses", "কম্বো": "combo", "প্যাক": "pack", "সেট": "set", "মেনস": "mens", "উইমেন": "women",
    "লেডিস": "ladies", "কিডস": "kids", "বয়েজ": "boys", "গার্লস": "girls", "স্পোর্টস": "sports", "স্পোর্ট": "sport", "ক্যাজুয়াল": "casual",
    "ফর্মাল": "formal", "ট্রেনিং": "training", "রানিং": "running",
}

# --- Words for products.
PRODUCT_WORDS = {
    "শার্ট": "shirt", "টিশার্ট": "tshirt", "প্যান্ট": "pant", "পাজামা": "pajama", "লুঙ্গি": "lungi", "গেঞ্জি": "vest undershirt", "বক্সার": "boxer",
    "আন্ডারওয়্যার": "underwear", "ব্রিফ": "brief", "জ্যাকেট": "jacket", "হুডি": "hoodie", "সোয়েটার": "sweater", "কোট": "coat", "ব্লেজার": "blazer",
    "শাড়ি": "saree", "কুর্তা": "kurta", "পাঞ্জাবি": "panjabi", "ফ্রক": "frock", "ড্রেস": "dress", "লেগিংস": "leggings", "জিন্স": "jeans",
    "শর্টস": "shorts", "ট্রাউজার": "trouser", "স্কার্ট": "skirt", "টপস": "tops", "ব্লাউজ": "blouse", "জুতা": "shoes", "স্যান্ডেল": "sandal",
    "স্নিকার": "sneaker", "বুট": "boot", "স্লিপার": "slipper", "হিল": "heels", "ব্যাগ": "bag", "ব্যাকপ্যাক": "backpack", "পার্স": "purse",
    "ওয়ালেট": "wallet", "বেল্ট": "belt", "টুপি": "cap hat", "মোজা": "socks", "স্কার্ফ": "scarf", "সানগ্লাস": "sunglasses", "ঘড়ি": "watch",
    "কম্বো": "combo", "পিচ": "piece", "পিস": "piece", "সেট": "set", "প্যাক": "pack", "জোড়া": "pair", "ডজন": "dozen", "মেনস": "mens", "মেন": "men",
    "উইমেন": "women", "লেডিস": "ladies", "কিডস": "kids", "বয়েজ": "boys", "গার্লস": "girls", "বাচ্চা": "kids children", "ছেলে": "boys mens",
    "মেয়ে": "girls womens", "লাল": "red", "নীল": "blue", "কালো": "black", "সাদা": "white", "হলুদ": "yellow", "সবুজ": "green", "ধূসর": "grey",
    "বাদামি": "brown", "গোলাপি": "pink", "কমলা": "orange", "বেগুনি": "purple", "নেভি": "navy", "ছোট": "small", "বড়": "large big", "মাঝারি": "medium",
    "সুতা": "cotton thread", "পলিয়েস্টার": "polyester", "কটন": "cotton", "লিনেন": "linen", "ডেনিম": "denim", "ফ্লিস": "fleece", "জার্সি": "jersey",
    "সিল্ক": "silk", "উল": "wool", "স্পোর্টস": "sports", "স্পোর্ট": "sport", "ক্যাজুয়াল": "casual", "ফর্মাল": "formal", "ট্রেনিং": "training",
    "রানিং": "running", "জিম": "gym", "ফুটবল": "football", "ক্রিকেট": "cricket",
}

# --- Words of intent; those without a meaning here are dropped.
INTENT_WORDS = {
    "দাম": "price", "মূল্য": "price", "কত": "how much", "কাত": "how much", "দর": "rate price", "আছে": "available", "পাওয়া": "available",
    "নেই": "not available", "স্টক": "stock", "ফেরত": "return", "বিনিময়": "exchange", "পলিসি": "policy", "নীতি": "policy", "ডেলিভারি": "delivery",
    "ওয়ারেন্টি": "warranty", "গ্যারান্টি": "guarantee", "এর": "", "এটির": "", "এটা": "", "এটি": "", "ওটার": "", "ওটা": "", "সেটার": "", "সেটি": "",
    "সেটা": "", "এগুলোর": "", "এগুলো": "", "কি": "", "কী": "", "কোনটা": "which", "কোথায়": "where", "কখন": "when", "কিভাবে": "how", "কেন": "why",
    "রঙ": "color", "সাইজ": "size", "কাপড়": "fabric", "পণ্য": "product",
}

# --- Words of intent in Latin letters.
LATIN_INTENT_WORDS = {
    "dam": "price", "daam": "price", "dor": "rate price", "koto": "how much", "kemon": "how", "ache": "available", "nai": "not available",
    "nei": "not available", "er": "", "ke": "", "te": "", "pathano": "delivery send", "ferot": "return", "ferat": "return", "bodol": "exchange",
    "taka": "BDT", "din": "days", "somoy": "time", "kobe": "when", "kothay": "where", "keno": "why", "kivabe": "how", "asol": "original authentic",
    "nakol": "fake duplicate",
}

# --- Sounds of letters; pairs come before single letters.
LETTERS = {
    "ক": "k", "খ": "kh", "গ": "g", "ঘ": "gh", "ঙ": "ng", "চ": "ch", "ছ": "chh", "জ": "j", "ঝ": "jh", "ট": "t", "ঠ": "th", "ড": "d", "ঢ": "dh",
    "ণ": "n", "ত": "t", "থ": "th", "দ": "d", "ধ": "dh", "ন": "n", "প": "p", "ফ": "ph", "ব": "b", "ভ": "bh", "ম": "m", "য": "y", "র": "r", "ল": "l",
    "শ": "sh", "ষ": "sh", "স": "s", "হ": "h", "ড়": "r", "ঢ়": "rh", "য়": "y", "ৎ": "t", "ং": "ng", "ঃ": "h", "ঁ": "", "অ": "o", "আ": "a", "ই": "i",
    "ঈ": "i", "উ": "u", "ঊ": "u", "ঋ": "ri", "এ": "e", "ঐ": "oi", "ও": "o", "ঔ": "ou", "া": "a", "ি": "i", "ী": "i", "ু": "u", "ূ": "u", "ৃ": "ri",
    "ে": "e", "ৈ": "oi", "ো": "o", "ৌ": "ou", "্": "",
}

# --- What transliteration makes of misspelt words.
SOUND_FIXES = {
    "brip": "brief", "brif": "brief", "briphs": "briefs", "boxer": "boxer", "bokshar": "boxer", "boksar": "boxer", "prais": "price", "praiz": "price",
    "prise": "price", "praice": "price", "shaiz": "size", "shaize": "size", "sais": "size", "kalar": "color", "colour": "color", "kolour": "color",
    "shart": "shirt", "shert": "shirt", "tishirt": "tshirt", "tee-shirt": "tshirt", "phyant": "pant", "pyant": "pant", "jyaket": "jacket",
    "jaket": "jacket", "hudi": "hoodie", "hoodee": "hoodie", "kombo": "combo", "phyak": "pack", "pyak": "pack", "delivari": "delivery",
    "deliveri": "delivery", "shiping": "shipping", "sheping": "shipping", "ritern": "return", "ritarn": "return", "ekscheinj": "exchange",
    "excheinj": "exchange", "diskount": "discount", "diskaunt": "discount", "ophaar": "offer", "ophar": "offer", "koyaliti": "quality",
    "kwality": "quality", "orijinal": "original", "orijinaL": "original",
}

# --- Shorthand, word by word.
SHORTHAND = {
    "ctg": "Chittagong", "dhk": "Dhaka", "sylhet": "Sylhet", "khulna": "Khulna", "rajshahi": "Rajshahi", "barisal": "Barisal",
    "mymensingh": "Mymensingh", "narayanganj": "Narayanganj", "gazipur": "Gazipur", "bd": "Bangladesh", "poly": "polyester", "cot": "cotton",
    "linen": "linen fabric", "denim": "denim fabric", "fleece": "fleece fabric", "jersey": "jersey fabric", "emi": "installment payment",
    "cod": "cash on delivery", "oos": "out of stock", "instock": "in stock", "avail": "available", "qty": "quantity", "pcs": "pieces",
    "xl": "extra large size", "xxl": "double extra large size", "xxxl": "triple extra large size", "tk": "taka BDT", "bdt": "BDT Bangladesh Taka",
    "usd": "USD US Dollar", "info": "information", "desc": "description", "spec": "specifications", "specs": "specifications", "img": "image",
    "pic": "picture", "pls": "please", "plz": "please", "asap": "as soon as possible", "faq": "frequently asked questions", "tnx": "thank you",
    "thx": "thank you", "vs": "versus comparison", "diff": "difference",
}

# --- Phrases that are widened, in this order.
PHRASES = {
    "return policy": "return and exchange policy refund", "exchange policy": "return and exchange policy refund",
    "refund policy": "return and exchange policy refund", "shipping policy": "shipping delivery policy",
    "delivery time": "shipping delivery time days", "how long delivery": "shipping delivery time days", "free shipping": "free shipping delivery",
    "cash on delivery": "cash on delivery COD payment", "out of stock": "out of stock unavailable", "in stock": "in stock available",
    "size chart": "size guide chart measurements", "size guide": "size guide chart measurements", "wash care": "washing care instructions",
    "care instruction": "washing care instructions", "product detail": "product details specifications description",
    "all variant": "all variants sizes colors options", "color option": "color options available colors",
    "size option": "size options available sizes",
}
