"""Vocabularies of the domain, kept as data."""

# fixed values: Indonesian month spellings
MONTHS = {
    "januari": 1, "jan": 1, "februari": 2, "pebruari": 2, "feb": 2, "peb": 2, "maret": 3, "mar": 3, "april": 4, "apr": 4, "mei": 5, "juni": 6, "jun": 6,
    "juli": 7, "jul": 7, "agustus": 8, "agt": 8, "agu": 8, "ags": 8, "agust": 8, "september": 9, "sep": 9, "sept": 9, "oktober": 10, "okt": 10,
    "november": 11, "nopember": 11, "nov": 11, "nop": 11, "desember": 12, "des": 12,
}
MONTH_NAMES = ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember"]

# fixed values: fuel kinds and the patterns of each, most specific first
FUELS = {
    "Solar/Biosolar": [r"bio\s*-?\s*solar", r"\bsolar\b", r"\bhsd\b", "high speed diesel", "minyak solar"],
    "Pertalite": ["pertalite", r"pertalit\b"],
    "Premium": [r"\bpremium\b"],
    "Bensin (jenis tidak disebut)": [r"\bbensin\b"],
    "Pertamax": ["pertamax"],
    "Dexlite": ["dexlite"],
    "Pertamina Dex": [r"pertamina\s+dex\b"],
    "Minyak tanah": [r"minyak\s+tanah", r"\bkerosin", r"\bkerosene"],
    "Avtur": [r"\bavtur\b"],
    "MFO/Minyak bakar": [r"\bmfo\b", "marine fuel oil", "minyak bakar"],
    "Minyak mentah": [r"minyak\s+mentah", "crude oil", "kondensat"],
    "LPG/Gas": [r"\blpg\b", "elpiji", r"\bgas\s+(?:3|tiga|12|dua belas)\s*kg", "tabung gas"],
}
NOT_CORE = ["Minyak mentah", "LPG/Gas"]
GENERIC_FUEL = [r"\bbbm\b", "bahan bakar minyak"]
# fixed values: evidence keywords
KEYWORDS = {
    "BBM": r"\bB\.?B\.?M\b",
    "bahan bakar minyak": r"bahan\s+bakar\s+minyak",
    "solar": r"(?<!bio)(?<!bio )(?<!bio-)\bsolar\b",
    "biosolar": r"bio\s*-?\s*solar",
    "minyak tanah": r"minyak\s+tanah",
    "pertalite": "pertalit",
}
# fixed values: dummies of the coded fuel column
DUMMIES = {
    "bbm_solar": "solar|hsd", "bbm_pertalite": "pertalite", "bbm_premium": "premium", "bbm_pertamax": "pertamax", "bbm_dexlite": "dexlite",
    "bbm_minyak_tanah": "minyak tanah", "bbm_minyak_mentah_olahan": "minyak mentah|olahan ilegal|kondensat", "bbm_tidak_disebut": "jenis tidak disebut",
}
# fixed values: kinds of rupiah amounts, by keyword; earlier ones win ties
MONEY_KINDS = [
    ("kerugian_negara", r"kerugian\s+(?:keuangan\s+)?negara"),
    ("hasil_lelang", "lelang"),
    ("biaya_perkara", r"biaya\s+perkara"),
    ("denda", "denda"),
    ("keuntungan", "keuntungan|untung|laba|upah|imbalan"),
    ("nilai_transaksi", "harga|seharga|dijual|menjual|membeli|dibeli|senilai|nilai|total"),
]
# fixed values: articles of the oil and gas act and the phrases of each offence
ARTICLES = {
    "53a": "Pengolahan tanpa izin usaha", "53b": "Pengangkutan tanpa izin usaha", "53c": "Penyimpanan tanpa izin usaha",
    "53d": "Niaga tanpa izin usaha", "54": "Meniru/memalsukan BBM", "55": "Penyalahgunaan pengangkutan/niaga BBM bersubsidi",
}
OFFENCES = [
    (r"menyalahgunakan\s+(pengangkutan|niaga)|penyalahgunaan\s+(pengangkutan|niaga)|disubsidi\s+pemerintah|bersubsidi", "55"),
    (r"tanpa\s+izin\s+usaha\s+pengolahan", "53a"),
    (r"tanpa\s+izin\s+usaha\s+pengangkutan", "53b"),
    (r"tanpa\s+izin\s+usaha\s+penyimpanan", "53c"),
    (r"tanpa\s+izin\s+usaha\s+niaga", "53d"),
    (r"meniru\s+atau\s+memalsukan|memalsukan\s+bahan\s+bakar", "54"),
    (r"pengolahan\s+tanpa|mengolah.{0,40}tanpa\s+izin", "53a"),
    (r"pengangkutan.{0,80}tanpa\s+izin|mengangkut.{0,80}tanpa\s+izin", "53b"),
    (r"penyimpanan.{0,80}tanpa\s+izin|menyimpan.{0,80}tanpa\s+izin", "53c"),
    (r"niaga.{0,80}tanpa\s+izin", "53d"),
]
# fixed values: the stages a court level may record, order of stages, order of levels for facts
STAGES_OF = {"PN": ["Pertama"], "PT": ["Banding"], "MA": ["Kasasi", "Peninjauan Kembali"], "Pengadilan Militer": ["Pertama", "Banding"]}
STAGE_ORDER = {"Pertama": 0, "Banding": 1, "Kasasi": 2, "Peninjauan Kembali": 3}
FACT_ORDER = {"PN": 0, "Pengadilan Militer": 1, "PT": 2, "MA": 3}
# fixed values: fuel words of a record and what its text must then hold
FUEL_CHECK = {
    "solar": "solar|hsd|high speed diesel", "pertalite": "pertalit", "premium": "premium", "pertamax": "pertamax", "dexlite": "dexlite",
    "minyak tanah": r"minyak\s*tanah|kerosin", "minyak mentah": r"minyak\s*mentah|crude|kondensat",
}
# fixed values: columns of a decision record
RECORD = [
    "no", "nomor_putusan", "pengadilan", "tingkat_persidangan", "tingkat_proses", "tanggal_putusan", "tahun_putusan", "tahun_kejadian", "hasil_putusan",
    "rincian_amar", "barang_bbm", "relevan_bbm", "nilai_kerugian_uang", "mata_uang", "dasar_nilai_uang", "nilai_kerugian_volume", "satuan_volume",
    "keterangan_volume", "sumber_data", "lampiran_pdf", "file_pdf", "rantai_perkara", "klasifikasi", "sumber_daftar", "url_putusan", "bukti_kutipan", "catatan",
]
RECORD_TYPES = {"no": "int", "tahun_putusan": "int", "nilai_kerugian_uang": "double", "nilai_kerugian_volume": "double"}
#: province -> places with a court, the default gazetteer: the seats and the courts named most often.
#: Further places come as a table (provinsi, tempat), see ``records.gazetteer``
PLACES = {
    "Aceh": ["Banda Aceh", "Lhokseumawe", "Langsa", "Meulaboh", "Sigli"],
    "Sumatera Utara": ["Medan", "Binjai", "Stabat", "Kisaran", "Lubuk Pakam", "Rantau Prapat", "Sibolga", "Tanjung Balai", "Simalungun"],
    "Sumatera Barat": ["Padang", "Koto Baru", "Bukittinggi", "Payakumbuh", "Pariaman", "Solok", "Painan"],
    "Riau": ["Pekanbaru", "Bengkalis", "Dumai", "Pelalawan", "Rengat", "Tembilahan", "Bangkinang", "Rokan Hilir"],
    "Kepulauan Riau": ["Tanjung Pinang", "Batam", "Tanjung Balai Karimun", "Natuna"],
    "Jambi": ["Jambi", "Muara Bungo", "Sarolangun", "Bangko", "Kuala Tungkal", "Sengeti"],
    "Bengkulu": ["Bengkulu", "Curup", "Manna"],
    "Sumatera Selatan": ["Palembang", "Lubuk Linggau", "Sekayu", "Kayu Agung", "Muara Enim", "Baturaja"],
    "Kepulauan Bangka Belitung": ["Pangkal Pinang", "Sungailiat", "Tanjung Pandan"],
    "Lampung": ["Tanjung Karang", "Metro", "Kalianda", "Kotabumi", "Menggala"],
    "Banten": ["Serang", "Tangerang", "Pandeglang", "Rangkasbitung"],
    "DKI Jakarta": ["Jakarta Pusat", "Jakarta Selatan", "Jakarta Timur", "Jakarta Barat", "Jakarta Utara"],
    "Jawa Barat": ["Bandung", "Bekasi", "Bogor", "Cibinong", "Cirebon", "Indramayu", "Karawang", "Subang", "Tasikmalaya"],
    "Jawa Tengah": ["Semarang", "Cilacap", "Purwokerto", "Tegal", "Pekalongan", "Pati", "Rembang", "Surakarta", "Magelang"],
    "DI Yogyakarta": ["Yogyakarta", "Sleman", "Bantul"],
    "Jawa Timur": ["Surabaya", "Sidoarjo", "Gresik", "Malang", "Tuban", "Lamongan", "Bojonegoro", "Probolinggo", "Jember", "Banyuwangi", "Situbondo", "Bangkalan"],
    "Bali": ["Denpasar", "Singaraja", "Negara"],
    "Nusa Tenggara Barat": ["Mataram", "Sumbawa Besar", "Raba Bima", "Selong"],
    "Nusa Tenggara Timur": ["Kupang", "Atambua", "Ende", "Maumere", "Labuan Bajo"],
    "Kalimantan Barat": ["Pontianak", "Singkawang", "Sambas", "Sintang", "Ketapang"],
    "Kalimantan Tengah": ["Palangkaraya", "Sampit", "Pangkalan Bun", "Muara Teweh", "Nanga Bulik", "Kuala Kapuas"],
    "Kalimantan Selatan": ["Banjarmasin", "Banjarbaru", "Martapura", "Pelaihari", "Kotabaru", "Batulicin", "Rantau", "Marabahan"],
    "Kalimantan Timur": ["Samarinda", "Balikpapan", "Tenggarong", "Bontang", "Tanah Grogot", "Tanjung Redeb"],
    "Kalimantan Utara": ["Tanjung Selor", "Tarakan", "Nunukan"],
    "Sulawesi Utara": ["Manado", "Bitung", "Kotamobagu"],
    "Gorontalo": ["Gorontalo", "Limboto"],
    "Sulawesi Tengah": ["Palu", "Luwuk", "Poso"],
    "Sulawesi Barat": ["Mamuju", "Polewali"],
    "Sulawesi Selatan": ["Makassar", "Maros", "Pangkajene", "Pare Pare", "Palopo", "Bulukumba"],
    "Sulawesi Tenggara": ["Kendari", "Kolaka", "Unaaha"],
    "Maluku": ["Ambon", "Masohi", "Tual"],
    "Maluku Utara": ["Ternate", "Tobelo"],
    "Papua": ["Jayapura", "Biak", "Serui", "Nabire"],
    "Papua Barat": ["Manokwari", "Fak Fak"],
    "Papua Barat Daya": ["Sorong"],
    "Papua Selatan": ["Merauke"],
    "Papua Tengah": ["Timika"],
    "Papua Pegunungan": ["Wamena"],
}
# fixed values: lines of every page of a ruling's file that are not its text
BOILERPLATE = [
    r"^Mahkamah Agung Republik Indonesia$",
    r"^Direktori Putusan Mahkamah Agung Republik Indonesia$",
    r"^putusan\.mahkamahagung\.go\.id$",
    r"^Disclaimer$",
    r"^Kepaniteraan Mahkamah Agung Republik Indonesia berusaha untuk selalu mencantumkan",
    r"^pelaksanaan fungsi peradilan\. Namun dalam hal-hal tertentu",
    r"^Dalam hal Anda menemukan inakurasi informasi",
    r"^Email\s*:\s*kepaniteraan@mahkamahagung\.go\.id",
    r"^Hal(aman|\.)?\s*\d+\s*(dari|dr\.?)\s*\d+",
    r"^Halaman\s*\d+\s*$",
]
#: part of the key of cached texts: raise it when the cleaning changes
CLEAN_VERSION = 2
# fixed values: relevance labels of the final record
FINAL_RELEVANCE = ["Ya", "Perlu dicek (tanpa PDF)", "Perlu dicek (putusan terkait BBM)"]
