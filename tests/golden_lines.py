"""Hand-labelled ingredient lines: file, line, and what it says; a key that is missing asserts nothing, null asserts none."""

from __future__ import annotations

# The labelled lines of six recipes.
GOLDEN = [
    ("birria", "1 kg Rindfleisch (Schulter oder Brust, in große Stücke geschnitten)", {"qty": 1, "unit": "kg", "item": "Rindfleisch", "note": "Schulter oder Brust, in große Stücke geschnitten"}),
    ("birria", "500 ml Rinderbrühe", {"qty": 500, "unit": "ml", "item": "Rinderbrühe", "note": None}),
    ("birria", "4 getrocknete Guajillo-Chilis (entkernt)", {"qty": 4, "unit": "Stück", "item": "getrocknete Guajillo-Chilis", "note": "entkernt"}),
    ("birria", "3 getrocknete Ancho-Chilis (entkernt)", {"qty": 3, "unit": "Stück", "item": "getrocknete Ancho-Chilis", "note": "entkernt"}),
    ("birria", "1 mittelgroße weiße Zwiebel (grob gehackt)", {"qty": 1, "unit": "Stück", "item": "weiße Zwiebel", "note": "mittelgroß, grob gehackt"}),
    ("birria", "5 clove Knoblauchzehen", {"qty": 5, "unit": None, "item": "Knoblauchzehen", "note": None}),
    ("birria", "2 Lorbeerblätter", {"qty": 2, "unit": "Stück", "item": "Lorbeerblätter", "note": None}),
    ("birria", "1 tsp Kreuzkümmel", {"qty": 1, "unit": "TL", "item": "Kreuzkümmel", "note": None}),
    ("birria", "1 tsp Oregano (vorzugsweise mexikanischer Oregano)", {"qty": 1, "unit": "TL", "item": "Oregano", "note": "vorzugsweise mexikanischer Oregano"}),
    ("birria", "1 tsp Salz", {"qty": 1, "unit": "TL", "item": "Salz", "note": None}),
    ("birria", "0.5 tsp schwarzer Pfeffer", {"qty": 0.5, "unit": "TL", "item": "schwarzer Pfeffer", "note": None}),
    ("birria", "2 tbsp Apfelessig", {"qty": 2, "unit": "EL", "item": "Apfelessig", "note": None}),
    ("birria", "12 kleine Maistortillas", {"qty": 12, "unit": "Stück", "item": "Maistortillas", "note": "klein"}),
    ("birria", "200 g geriebener Käse (Mozzarella oder einen anderen milden Käse)", {"qty": 200, "unit": "g", "item": "geriebener Käse", "note": "Mozzarella oder einen anderen milden Käse"}),
    ("birria", "Frischer Koriander (gehackt (zum Garnieren))", {"item": "Koriander", "note": "frisch, gehackt, zum Garnieren"}),
    ("birria", "Kleine weiße Zwiebel (gewürfelt (zum Garnieren))", {"item": "weiße Zwiebel", "note": "klein, gewürfelt, zum Garnieren"}),
    ("birria", "Limettenspalten (zum Servieren)", {"item": "Limettenspalten", "note": "zum Servieren"}),
    ("easy", "10 chicken thighs (skinless, boneless)", {"qty": 10, "unit": "Stück", "item": "chicken thighs", "note": "skinless, boneless"}),
    ("easy", "1 onion (large, for chicken tower base)", {"qty": 1, "unit": "Stück", "item": "onion", "note": "large, for chicken tower base"}),
    ("easy", "3 tablespoons Greek yogurt", {"qty": 3, "unit": "EL", "item": "Greek yogurt", "note": None}),
    ("easy", "1 tablespoon lemon juice (freshly squeezed)", {"qty": 1, "unit": "EL", "item": "lemon juice", "note": "freshly squeezed"}),
    ("easy", "3 clove garlic (finely grated)", {"qty": 3, "unit": None, "item": "garlic", "note": "finely grated"}),
    ("easy", "2 teaspoons paprika", {"qty": 2, "unit": "TL", "item": "paprika", "note": None}),
    ("easy", "0.5 teaspoon ground cumin", {"qty": 0.5, "unit": "TL", "item": "ground cumin", "note": None}),
    ("easy", "0.5 teaspoon oregano", {"qty": 0.5, "unit": "TL", "item": "oregano", "note": None}),
    ("easy", "0.5 teaspoon red pepper flakes", {"qty": 0.5, "unit": "TL", "item": "red pepper flakes", "note": None}),
    ("easy", "ground cinnamon (a pinch)", {"item": "ground cinnamon", "note": "a pinch"}),
    ("easy", "2 teaspoons salt", {"qty": 2, "unit": "TL", "item": "salt", "note": None}),
    ("easy", "■■■■ TOPPING: ■■■■■", {"item": "TOPPING", "note": None}),
    ("easy", "0.5 onion (red, thinly sliced)", {"qty": 0.5, "unit": "Stück", "item": "onion", "note": "red, thinly sliced"}),
    ("easy", "1 tablespoon ground sumac", {"qty": 1, "unit": "EL", "item": "ground sumac", "note": None}),
    ("easy", "salt (to taste)", {"item": "salt", "note": "to taste"}),
    ("ente", "½ TK Enten (vorgegart und aufgetaut)", {"qty": 0.5, "unit": "Stück", "item": "Ente", "note": "TK, vorgegart und aufgetaut"}),
    ("ente", "2 tbsp Mehl", {"qty": 2, "unit": "EL", "item": "Mehl", "note": None}),
    ("ente", "30 ml Wasser", {"qty": 30, "unit": "ml", "item": "Wasser", "note": None}),
    ("ente", "Neutrales Öl zum Ausbacken", {"item": "Neutrales Öl", "note": "zum Ausbacken"}),
    ("ente", "160 g Basmatireis", {"qty": 160, "unit": "g", "item": "Basmatireis", "note": None}),
    ("ente", "240 ml Wasser", {"qty": 240, "unit": "ml", "item": "Wasser", "note": None}),
    ("ente", "1 clove Knoblauchzehe", {"qty": 1, "unit": None, "item": "Knoblauchzehe", "note": None}),
    ("ente", "6 g Ingwer", {"qty": 6, "unit": "g", "item": "Ingwer", "note": None}),
    ("ente", "50 g Schalotten", {"qty": 50, "unit": "g", "item": "Schalotten", "note": None}),
    ("ente", "2 Frühlingszwiebeln", {"qty": 2, "unit": "Stück", "item": "Frühlingszwiebeln", "note": None}),
    ("ente", "50 g Karotten", {"qty": 50, "unit": "g", "item": "Karotten", "note": None}),
    ("ente", "½ Paprika (rot)", {"qty": 0.5, "unit": "Stück", "item": "Paprika", "note": "rot"}),
    ("ente", "2 Pak Choi", {"qty": 2, "unit": "Stück", "item": "Pak Choi", "note": None}),
    ("ente", "100 g frische Shiitake-Pilze", {"qty": 100, "unit": "g", "item": "Shiitake-Pilze", "note": "frisch"}),
    ("ente", "50 g Bambusstreifen aus der Dose", {"qty": 50, "unit": "g", "item": "Bambusstreifen", "note": "aus der Dose"}),
    ("ente", "1 tbsp Erdnussöl", {"qty": 1, "unit": "EL", "item": "Erdnussöl", "note": None}),
    ("ente", "2 tbsp helle Sojasauce", {"qty": 2, "unit": "EL", "item": "helle Sojasauce", "note": None}),
    ("ente", "1 tbsp Speisestärke", {"qty": 1, "unit": "EL", "item": "Speisestärke", "note": None}),
    ("ente", "2 tbsp Reisessig", {"qty": 2, "unit": "EL", "item": "Reisessig", "note": None}),
    ("ente", "30 ml Austernsauce", {"qty": 30, "unit": "ml", "item": "Austernsauce", "note": None}),
    ("ente", "200 ml Hühnerbrühe", {"qty": 200, "unit": "ml", "item": "Hühnerbrühe", "note": None}),
    ("ente", "½ EL Sambal Oelek", {"qty": 0.5, "unit": "EL", "item": "Sambal Oelek", "note": None}),
    ("ente", "50 g Mungobohnensprossen", {"qty": 50, "unit": "g", "item": "Mungobohnensprossen", "note": None}),
    ("ente", "Salz & Pfeffer", {"item": "Salz & Pfeffer", "note": None}),
    ("ente", "Frischer Koriander", {"item": "Koriander", "note": "frisch"}),
    ("ente", "Frische Mungobohnensprossen", {"item": "Mungobohnensprossen", "note": "frisch"}),
    ("haehnchen", "750 g Hähnchenschenkel oder -brust (in mundgerechte Stücke geschnitten)", {"qty": 750, "unit": "g", "item": "Hähnchenschenkel oder -brust", "note": "in mundgerechte Stücke geschnitten"}),
    ("haehnchen", "200 g Naturjoghurt", {"qty": 200, "unit": "g", "item": "Naturjoghurt", "note": None}),
    ("haehnchen", "2 tbsp Ingwer-Knoblauch-Paste", {"qty": 2, "unit": "EL", "item": "Ingwer-Knoblauch-Paste", "note": None}),
    ("haehnchen", "1 tsp Garam Masala", {"qty": 1, "unit": "TL", "item": "Garam Masala", "note": None}),
    ("haehnchen", "1 tsp Chilipulver", {"qty": 1, "unit": "TL", "item": "Chilipulver", "note": None}),
    ("haehnchen", "½ TL Kurkuma", {"qty": 0.5, "unit": "TL", "item": "Kurkuma", "note": None}),
    ("haehnchen", "Saft einer halben Zitrone", {"qty": 0.5, "unit": "Stück", "item": "Zitrone", "note": "Saft"}),
    ("haehnchen", "Salz nach Geschmack", {"item": "Salz", "note": "nach Geschmack"}),
    ("haehnchen", "2 tbsp Pflanzenöl", {"qty": 2, "unit": "EL", "item": "Pflanzenöl", "note": None}),
    ("haehnchen", "500 g Basmati-Reis (gewaschen und 30 Minuten eingeweicht)", {"qty": 500, "unit": "g", "item": "Basmati-Reis", "note": "gewaschen und 30 Minuten eingeweicht"}),
    ("haehnchen", "5 Liter Wasser", {"qty": 5, "unit": "l", "item": "Wasser", "note": None}),
    ("haehnchen", "1 Lorbeerblatt", {"qty": 1, "unit": "Stück", "item": "Lorbeerblatt", "note": None}),
    ("haehnchen", "2-3 grüne Kardamomkapseln (leicht angedrückt)", {"min_qty": 2, "max_qty": 3, "unit": "Stück", "item": "Kardamomkapseln", "note": "grün, leicht angedrückt"}),
    ("haehnchen", "2-3 Nelken", {"min_qty": 2, "max_qty": 3, "unit": "Stück", "item": "Nelken", "note": None}),
    ("haehnchen", "1 Zimtstange", {"qty": 1, "unit": "Stück", "item": "Zimtstange", "note": None}),
    ("haehnchen", "2 mittelgroße Zwiebeln (fein gehackt)", {"qty": 2, "unit": "Stück", "item": "Zwiebeln", "note": "mittelgroß, fein gehackt"}),
    ("haehnchen", "2 mittelgroße Tomaten (gewürfelt)", {"qty": 2, "unit": "Stück", "item": "Tomaten", "note": "mittelgroß, gewürfelt"}),
    ("haehnchen", "1 grüne Chili (Optional; fein gehackt)", {"qty": 1, "unit": "Stück", "item": "Chili", "note": "grün, optional, fein gehackt"}),
    ("haehnchen", "½ Bund Koriander (gehackt)", {"qty": 0.5, "unit": "bunch", "item": "Koriander", "note": "gehackt"}),
    ("haehnchen", "½ Bund Minze (gehackt)", {"qty": 0.5, "unit": "bunch", "item": "Minze", "note": "gehackt"}),
    ("haehnchen", "1 tsp Safranfäden (in 2 EL warmer Milch eingeweicht)", {"qty": 1, "unit": "TL", "item": "Safranfäden", "note": "in 2 EL warmer Milch eingeweicht"}),
    ("haehnchen", "2 tbsp Ghee oder Pflanzenöl", {"qty": 2, "unit": "EL", "item": "Ghee oder Pflanzenöl", "note": None}),
    ("haehnchen", "Optional: Röstzwiebeln", {"item": "Röstzwiebeln", "note": "optional"}),
    ("original", "600 g Hähnchenfleisch (Meine Empfehlung: Pollo Fino zu nehmen; gewürfelt & enthäutet)", {"qty": 600, "unit": "g", "item": "Hähnchenfleisch", "note": "Meine Empfehlung: Pollo Fino zu nehmen; gewürfelt & enthäutet"}),
    ("original", "4 clove Knoblauchzehen (gepresst)", {"qty": 4, "unit": None, "item": "Knoblauchzehen", "note": "gepresst"}),
    ("original", "2 tbsp Joghurt (.5% Fett)", {"qty": 2, "unit": "EL", "item": "Joghurt", "note": "0.5% Fett"}),
    ("original", "3 tbsp Olivenöl", {"qty": 3, "unit": "EL", "item": "Olivenöl", "note": None}),
    ("original", "0.5 Zitrone (Saft der Zitrone)", {"qty": 0.5, "unit": "Stück", "item": "Zitrone", "note": "Saft der Zitrone"}),
    ("original", "0.5 tsp Kurkuma", {"qty": 0.5, "unit": "TL", "item": "Kurkuma", "note": None}),
    ("original", "1 tsp Chili- und Paprikapulver (Garam Masala)", {"qty": 1, "unit": "TL", "item": "Chili- und Paprikapulver", "note": "Garam Masala"}),
    ("original", "Salz & Pfeffer nach Geschmack", {"item": "Salz & Pfeffer", "note": "nach Geschmack"}),
    ("original", "60 ml Öl zum anbraten (zb. Sonnenblumenöl)", {"qty": 60, "unit": "ml", "item": "Öl", "note": "zum Anbraten, z. B. Sonnenblumenöl"}),
    ("original", "15 g Ingwer (Stück)", {"qty": 15, "unit": "g", "item": "Ingwer", "note": "Stück"}),
    ("original", "1 große Zwiebel (gewürfelt)", {"qty": 1, "unit": "Stück", "item": "Zwiebel", "note": "groß, gewürfelt"}),
    ("original", "80 g Butter", {"qty": 80, "unit": "g", "item": "Butter", "note": None}),
    ("original", "60 g Cashewnüsse", {"qty": 60, "unit": "g", "item": "Cashewnüsse", "note": None}),
    ("original", "500 ml passierte Tomaten (oder 5 frische Tomaten (gewürfelt))", {"qty": 500, "unit": "ml", "item": "passierte Tomaten", "note": "oder 5 frische Tomaten, gewürfelt"}),
    ("original", "200 ml Schlagsahne", {"qty": 200, "unit": "ml", "item": "Schlagsahne", "note": None}),
    ("original", "1 tbsp getrocknete Bockshornkleeblätter", {"qty": 1, "unit": "EL", "item": "getrocknete Bockshornkleeblätter", "note": None}),
    ("original", "1 tsp Paprika (Chili-, Korianderpulver, Garam Masala, Kreuzkümmel)", {"qty": 1, "unit": "TL", "item": "Paprika", "note": "Chili-, Korianderpulver, Garam Masala, Kreuzkümmel"}),
    ("original", "0.25 tsp Zucker", {"qty": 0.25, "unit": "TL", "item": "Zucker", "note": None}),
    ("original", "frische gehackte Kräuter für Deko (zb. Petersilie oder Koriander)", {"item": "frische gehackte Kräuter", "note": "für Deko, z. B. Petersilie oder Koriander"}),
    ("original", "1 tsp Chiliflocken (hot) & getrockneten Bockshornklee (optional)", {"qty": 1, "unit": "TL", "item": "Chiliflocken & getrockneter Bockshornklee", "note": "hot, optional"}),
    ("zartes", "300 g Rindfleisch", {"qty": 300, "unit": "g", "item": "Rindfleisch", "note": None}),
    ("zartes", "5 EL Helle Sojasauce", {"qty": 5, "unit": "EL", "item": "Helle Sojasauce", "note": None}),
    ("zartes", "1 tsp Natron (Gestrichener TL)", {"qty": 1, "unit": "TL", "item": "Natron", "note": "Gestrichener TL"}),
    ("zartes", "1 tbsp Speisestärke", {"qty": 1, "unit": "EL", "item": "Speisestärke", "note": None}),
    ("zartes", "0.5 tsp Weißer Pfeffer", {"qty": 0.5, "unit": "TL", "item": "Weißer Pfeffer", "note": None}),
    ("zartes", "0.25 tsp Salz", {"qty": 0.25, "unit": "TL", "item": "Salz", "note": None}),
    ("zartes", "1 Prise Zucker", {"qty": 1, "unit": "pinch", "item": "Zucker", "note": None}),
    ("zartes", "1 tbsp Lee Kum Kee Black Pepper Sauce", {"qty": 1, "unit": "EL", "item": "Lee Kum Kee Black Pepper Sauce", "note": None}),
    ("zartes", "80 ml Geflügelfond", {"qty": 80, "unit": "ml", "item": "Geflügelfond", "note": None}),
    ("zartes", "1 tbsp Helle Sojasauce", {"qty": 1, "unit": "EL", "item": "Helle Sojasauce", "note": None}),
    ("zartes", "1 tbsp Austernsauce", {"qty": 1, "unit": "EL", "item": "Austernsauce", "note": None}),
    ("zartes", "1 tbsp Shaoxing Reiswein", {"qty": 1, "unit": "EL", "item": "Shaoxing Reiswein", "note": None}),
    ("zartes", "1 tbsp Zucker", {"qty": 1, "unit": "EL", "item": "Zucker", "note": None}),
    ("zartes", "0.5 tsp Schwarzer Pfeffer", {"qty": 0.5, "unit": "TL", "item": "Schwarzer Pfeffer", "note": None}),
    ("zartes", "1 Rote Paprikaschote", {"qty": 1, "unit": "Stück", "item": "Paprikaschote", "note": "rot"}),
    ("zartes", "2 Zwiebeln", {"qty": 2, "unit": "Stück", "item": "Zwiebel", "note": None}),
    ("zartes", "2 Frühlingszwiebeln", {"qty": 2, "unit": "Stück", "item": "Frühlingszwiebel", "note": None}),
    ("zartes", "30 g Ingwer", {"qty": 30, "unit": "g", "item": "Ingwer", "note": None}),
    ("zartes", "2 Portionen Gekochter Reis", {"item": "Gekochter Reis", "note": None}),
    ("zartes", "3-4 tbsp Pflanzenöl", {"min_qty": 3, "max_qty": 4, "unit": "EL", "item": "Pflanzenöl", "note": None}),
]
