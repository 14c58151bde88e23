"""A small corpus of our own: a procedure and a policy whose clauses exercise every extractor."""

PROCEDURE = """PR-TST-01
PROCÉDURE D'ESSAI DES EXTINCTEURS
ET DES ALARMES

Version : 4
Date d'application : 02/05/2024
Site : Tournai

1. OBJET

1.1 La présente procédure est conforme à la norme ISO 9001:2015.

1.2 Elle renvoie au § 3.2 et à l'instruction IT-TST-07.

2. CONTRÔLES

2.1 Chaque extincteur doit être contrôlé tous les trimestres.

2.2 En zone B, le contrôle visuel est requis avant chaque mise en service.

2.3 Le chef d'équipe doit :
    a) vider les cuves ;
    b) noter les relevés ;
    c) prévenir le gardien.

2.4 Les rôles sont les suivants :

Tâche | Réalisation | Approbation
Relevé | Gardien | Chef de site
Essai | Technicien | Directeur

3. DÉLAIS

3.1 Le rapport est transmis sous 48 heures.

3.2 La fiche est corrigée sous 5 jours ouvrés.

3.3 Les relevés sont archivés pendant 3 ans.

3.4 En cas d'alarme, l'atelier est évacué immédiatement.

3.5 Le port d'un casque est obligatoire au-delà de 85 dB(A).

4. DÉROGATIONS

4.1 Par dérogation au § 2.1, le contrôle est semestriel, motivé par l'arrêt du four, approuvé par le Directeur le 3 mars 2026, valable jusqu'au 30 juin 2026.
"""

POLICY = """POL-TST-02
POLITIQUE SÉCURITÉ

Version : 1
Date d'application : 2025-01-15

1. RÈGLES

1.1 On entend par « alarme » tout signal sonore ou lumineux.

1.2 Les travaux ne sont pas autorisés lorsque le vent dépasse 60 km/h.

1.3 L'opérateur peut reprendre son poste après validation du gardien.

1.4 La vérification des extincteurs est réalisée deux fois par an.

1.5 La formation comporte au minimum 14 heures.

1.6 L'habilitation est recyclée tous les 3 ans.

1.7 À compter du 1er janvier 2025, chaque équipe comporte au minimum deux secouristes.

1.8 Le port du harnais est requis à plus de 3 mètres.

1.9 Le compte rendu est remis dans la semaine.

1.10 Il est recommandé de porter des gants lors des chargements.

1.11 Les conduites délivrées restent valables jusqu'au 31 février 2026.

1.12 L'accès est interdit sur l'ensemble du site, sauf aux pompiers.
"""

TEXTS = (("D1", PROCEDURE), ("D2", POLICY))
