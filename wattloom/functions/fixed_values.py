"""Values that have to equal the published data set's for results to match."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------------

FOLDS = 5
DAYS_PER_YEAR = 365
WEEKS_PER_YEAR = 53

MONTHS = list(range(1, 13))
WEEKDAYS = list(range(1, 8))
HOURS = list(range(24))
SEASONS = [0, 1, 2]  # cold, hot, mild
TOU = [0, 1, 2]  # off peak, mid peak, on peak

COLD_MONTHS = [12, 1, 2]
HOT_MONTHS = [6, 7, 8]
MID_PEAK_HOURS = [13, 14, 15]
ON_PEAK_HOURS = [16, 17, 18, 19]

ENTITY = "bldg_id"
READING = "out.electricity.total.energy_consumption"

BINARY_TARGET = "building_stock_type"
COMMERCIAL_TARGETS = [
    "in.comstock_building_type_group_com",
    "in.heating_fuel_com",
    "in.hvac_category_com",
    "in.number_of_stories_com",
    "in.ownership_type_com",
    "in.vintage_com",
    "in.wall_construction_type_com",
    "in.tstat_clg_sp_f..f_com",
    "in.tstat_htg_sp_f..f_com",
    "in.weekday_opening_time..hr_com",
    "in.weekday_operating_hours..hr_com",
]
RESIDENTIAL_TARGETS = [
    "in.bedrooms_res",
    "in.cooling_setpoint_res",
    "in.heating_setpoint_res",
    "in.geometry_building_type_recs_res",
    "in.geometry_floor_area_res",
    "in.geometry_foundation_type_res",
    "in.geometry_wall_type_res",
    "in.heating_fuel_res",
    "in.income_res",
    "in.roof_material_res",
    "in.tenure_res",
    "in.vacancy_status_res",
    "in.vintage_res",
]

# Ordered categories; the code is the position in the list.
ORDINAL_LEVELS = {
    "in.number_of_stories_com": [
        "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "14", "20", "30",
    ],
    "in.vintage_com": [
        "Before 1946", "1946 to 1959", "1960 to 1969", "1970 to 1979",
        "1980 to 1989", "1990 to 1999", "2000 to 2012", "2013 to 2018",
    ],
    "in.weekday_opening_time..hr_com": [
        "3.5", "3.75", "4", "4.25", "4.5", "4.75", "5", "5.25", "5.5", "5.75", "6", "6.25", "6.5",
        "6.75", "7", "7.25", "7.5", "7.75", "8", "8.25", "8.5", "8.75", "9", "9.25", "9.5", "9.75",
        "10", "10.25", "10.5", "10.75", "11", "11.25", "11.5", "11.75", "12", "12.25",
    ],
    "in.weekday_operating_hours..hr_com": [
        "5.75", "6", "6.25", "6.5", "6.75", "7", "7.25", "7.5", "7.75", "8", "8.25", "8.5", "8.75",
        "9", "9.25", "9.5", "9.75", "10", "10.25", "10.5", "10.75", "11", "11.25", "11.5", "11.75",
        "12", "12.25", "12.5", "12.75", "13", "13.25", "13.5", "13.75", "14", "14.25", "14.5",
        "14.75", "15", "15.25", "15.5", "15.75", "16", "16.25", "16.5", "16.75", "17", "17.25",
        "17.5", "17.75", "18", "18.25", "18.5", "18.75",
    ],
    "in.bedrooms_res": ["1", "2", "3", "4", "5"],
    "in.cooling_setpoint_res": [
        "60F", "62F", "65F", "67F", "68F", "70F", "72F", "75F", "76F", "78F", "80F",
    ],
    "in.heating_setpoint_res": [
        "55F", "60F", "62F", "65F", "67F", "68F", "70F", "72F", "75F", "76F", "78F", "80F",
    ],
    "in.geometry_floor_area_res": [
        "0-499", "500-749", "750-999", "1000-1499", "1500-1999",
        "2000-2499", "2500-2999", "3000-3999", "4000+",
    ],
    "in.income_res": [
        "<10000", "10000-14999", "15000-19999", "20000-24999", "25000-29999",
        "30000-34999", "35000-39999", "40000-44999", "45000-49999", "50000-59999",
        "60000-69999", "70000-79999", "80000-99999", "100000-119999", "120000-139999",
        "140000-159999", "160000-179999", "180000-199999", "200000+",
    ],
    "in.vintage_res": [
        "<1940", "1940s", "1950s", "1960s", "1970s", "1980s", "1990s", "2000s", "2010s",
    ],
    "in.tstat_clg_sp_f..f_com": [
        "69", "70", "71", "72", "73", "74", "75", "76", "77", "79", "80", "999",
    ],
    "in.tstat_htg_sp_f..f_com": [
        "61", "63", "64", "65", "66", "67", "68", "69", "70", "71", "72", "999",
    ],
}

# State abbreviation and name, sorted by abbreviation; the state code is the position.
STATES = {
    "AK": "Alaska",
    "AL": "Alabama",
    "AR": "Arkansas",
    "AZ": "Arizona",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DC": "District Of Columbia",
    "DE": "Delaware",
    "FL": "Florida",
    "GA": "Georgia",
    "HI": "Hawaii",
    "IA": "Iowa",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "MA": "Massachusetts",
    "MD": "Maryland",
    "ME": "Maine",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MO": "Missouri",
    "MS": "Mississippi",
    "MT": "Montana",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "NE": "Nebraska",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NV": "Nevada",
    "NY": "New York",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VA": "Virginia",
    "VT": "Vermont",
    "WA": "Washington",
    "WI": "Wisconsin",
    "WV": "West Virginia",
    "WY": "Wyoming",
}

# Census fact -> column of the economics table.
CENSUS_FACTS = {
    "Population, percent change - April 1, 2020 (estimates base) to July 1, 2023, (V2023)": "pop_change_2020_2023",
    "Persons under 5 years, percent": "under_5_percent",
    "Persons under 18 years, percent": "under_18_percent",
    "Persons 65 years and over, percent": "over_65_percent",
    "Female persons, percent": "female_percent",
    "White alone, percent": "white_percent",
    "Black or African American alone, percent": "black_percent",
    "American Indian and Alaska Native alone, percent": "native_percent",
    "Asian alone, percent": "asian_percent",
    "Native Hawaiian and Other Pacific Islander alone, percent": "pacific_islander_percent",
    "Two or More Races, percent": "two_or_more_races_percent",
    "Hispanic or Latino, percent": "hispanic_percent",
    "White alone, not Hispanic or Latino, percent": "white_non_hispanic_percent",
    "Foreign born persons, percent, 2018-2022": "foreign_born_percent",
    "Owner-occupied housing unit rate, 2018-2022": "owner_occupied_rate",
    "Living in same house 1 year ago, percent of persons age 1 year+, 2018-2022": "same_house_1yr_percent",
    "Language other than English spoken at home, percent of persons age 5 years+, 2018-2022": "non_english_home_percent",
    "Households with a computer, percent, 2018-2022": "computer_percent",
    "Households with a broadband Internet subscription, percent, 2018-2022": "broadband_percent",
    "High school graduate or higher, percent of persons age 25 years+, 2018-2022": "high_school_grad_percent",
    "Bachelor's degree or higher, percent of persons age 25 years+, 2018-2022": "bachelors_percent",
    "With a disability, under age 65 years, percent, 2018-2022": "disability_percent",
    "Persons without health insurance, under age 65 years, percent": "no_health_insurance_percent",
    "In civilian labor force, total, percent of population age 16 years+, 2018-2022": "labor_force_total_percent",
    "In civilian labor force, female, percent of population age 16 years+, 2018-2022": "labor_force_female_percent",
    "Persons in poverty, percent": "poverty_percent",
    "Total employment, percent change, 2021-2022": "employment_change_2021_2022",
    "Population estimates, July 1, 2023, (V2023)": "pop_estimates_2023",
    "Population estimates base, April 1, 2020, (V2023)": "pop_estimates_base_2020",
    "Population, Census, April 1, 2020": "pop_census_2020",
    "Population, Census, April 1, 2010": "pop_census_2010",
    "Veterans, 2018-2022": "veterans_2018_2022",
    "Housing Units, July 1, 2023, (V2023)": "housing_units_2023",
    "Median value of owner-occupied housing units, 2018-2022": "median_house_value",
    "Median selected monthly owner costs -with a mortgage, 2018-2022": "median_costs_mortgage",
    "Median selected monthly owner costs -without a mortgage, 2018-2022": "median_costs_no_mortgage",
    "Median gross rent, 2018-2022": "median_rent",
    "Building Permits, 2023": "building_permits_2023",
    "Households, 2018-2022": "households_2018_2022",
    "Persons per household, 2018-2022": "persons_per_household",
    "Total accommodation and food services sales, 2017 ($1,000)": "accommodation_sales_2017",
    "Total health care and social assistance receipts/revenue, 2017 ($1,000)": "healthcare_revenue_2017",
    "Total transportation and warehousing receipts/revenue, 2017 ($1,000)": "transport_warehouse_revenue_2017",
    "Total retail sales, 2017 ($1,000)": "retail_sales_2017",
    "Total retail sales per capita, 2017": "retail_sales_per_capita_2017",
    "Mean travel time to work (minutes), workers age 16 years+, 2018-2022": "mean_travel_time",
    "Median household income (in 2022 dollars), 2018-2022": "median_income_2022",
    "Per capita income in past 12 months (in 2022 dollars), 2018-2022": "per_capita_income_2022",
    "Total employer establishments, 2022": "employer_establishments_2022",
    "Total employment, 2022": "total_employment_2022",
    "Total annual payroll, 2022 ($1,000)": "annual_payroll_2022",
    "Total nonemployer establishments, 2021": "nonemployer_establishments_2021",
    "All employer firms, Reference year 2017": "all_employer_firms_2017",
    "Men-owned employer firms, Reference year 2017": "men_owned_firms_2017",
    "Women-owned employer firms, Reference year 2017": "women_owned_firms_2017",
    "Minority-owned employer firms, Reference year 2017": "minority_owned_firms_2017",
    "Nonminority-owned employer firms, Reference year 2017": "nonminority_owned_firms_2017",
    "Veteran-owned employer firms, Reference year 2017": "veteran_owned_firms_2017",
    "Nonveteran-owned employer firms, Reference year 2017": "nonveteran_owned_firms_2017",
    "Population per square mile, 2020": "pop_density_2020",
    "Population per square mile, 2010": "pop_density_2010",
    "Land area in square miles, 2020": "land_area_2020",
    "Land area in square miles, 2010": "land_area_2010",
}

# Feature-name templates used to group permutation importances; the first that matches as a prefix wins.
NAME_TEMPLATES = [
    "average_hour_consumption_season_{season}_tou_{tou}",
    "average_hour_consumption_month_{month}_tou_{tou}",
    "average_hour_consumption_week_{week}_tou_{tou}",
    "average_hour_consumption_season_{season}_is_weekend_{is_weekend}",
    "average_hour_consumption_month_{month}_is_weekend_{is_weekend}",
    "average_hour_consumption_week_{week}_is_weekend_{is_weekend}",
    "average_daily_consumption_season_{season}_weekday_{weekday}",
    "average_daily_consumption_month_{month}_weekday_{weekday}",
    "average_hour_consumption_season_{season}",
    "average_hour_consumption_month_{month}",
    "average_hour_consumption_week_{week}",
    "average_daily_consumption_season_{season}",
    "average_daily_consumption_month_{month}",
    "average_daily_consumption_week_{week}",
    "total_average_consumption_weekday_{weekday}",
    "total_average_consumption_hour_{hour}",
    "total_consumption_season_{season}",
    "total_consumption_month_{month}",
    "total_consumption_week_{weeknum}",
    "average_robust_increment_{hour_minute}",
    "average_hour_consumption_national_holiday_tou_{tou}",
    "average_hour_consumption_state_holiday_tou_{tou}",
    "total_consumption_season_{season}_vs_state",
    "total_consumption_month_{month}_vs_state",
    "total_consumption_weekday_{weekday}_vs_state",
    "total_consumption_hour_{hour}_vs_state",
    "average_robust_increment_weekday_{weekday}",
    "average_robust_drop_weekday_{weekday}",
    "average_robust_drop_{hour_minute}",
]

# Shares of the final score.
BINARY_SHARE = 0.4
DETAIL_SHARE = 0.6

# --- end of fixed values ----------------------------------------------------------------------

STATE_CODES = {state: code for code, state in enumerate(STATES)}


def safe_name(name: str) -> str:
    """Dots would need back-ticks in every Spark expression."""
    return name.replace(".", "_")


ALL_TARGETS = [BINARY_TARGET, *COMMERCIAL_TARGETS, *RESIDENTIAL_TARGETS]

# Holidays of single states beyond the federal ones, as rules (state, name, rule, shift, first year, last year).
# A rule is a date ("month-day"), a weekday in a month ("month/which/weekday", weekday 0 is Monday, which -1 is the last; with
# "+days" after it) or days from Easter ("easter+days"). The shift says where a date on a weekend is kept: "near" for
# Friday or Monday, "monday" for Sunday only, "" for nowhere. A last year of 0 is none; a negative first year
# means even years only, from then on.
STATE_HOLIDAYS = [
    ("AK", "Seward's Day", "3/-1/0", "", 1918, 0),
    ("AK", "Alaska Day", "10-18", "near", 1867, 0),
    ("AL", "Confederate Memorial Day", "4/4/0", "", 1866, 0),
    ("AL", "Jefferson Davis Birthday", "6/1/0", "", 1890, 0),
    ("CA", "Cesar Chavez Day", "3-31", "monday", 1995, 0),
    ("CA", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("CO", "Frances Xavier Cabrini Day", "10/1/0", "", 2020, 0),
    ("CT", "Lincoln's Birthday", "2-12", "near", 1971, 0),
    ("CT", "Good Friday", "easter-2", "", 1900, 0),
    ("DC", "Emancipation Day", "4-16", "near", 2005, 0),
    ("DE", "Good Friday", "easter-2", "", 1900, 0),
    ("DE", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("DE", "Election Day", "11/1/0+1", "", -2008, 0),
    ("FL", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("GA", "State Holiday", "4/4/0", "", 2016, 0),
    ("GA", "Day After Thanksgiving", "11/4/3+1", "", 1986, 0),
    ("HI", "Prince Kuhio Day", "3-26", "near", 1949, 0),
    ("HI", "Good Friday", "easter-2", "", 1900, 0),
    ("HI", "Kamehameha Day", "6-11", "near", 1872, 0),
    ("HI", "Statehood Day", "8/3/4", "", 1959, 0),
    ("HI", "Election Day", "11/1/0+1", "", -2008, 0),
    ("IL", "Lincoln's Birthday", "2-12", "", 1971, 0),
    ("IL", "Casimir Pulaski Day", "3/1/0", "", 1978, 0),
    ("IL", "Election Day", "11/1/0+1", "", -2008, 0),
    ("IN", "Good Friday", "easter-2", "", 1900, 0),
    ("IN", "Primary Election Day", "5/1/0+1", "", -2006, 0),
    ("IN", "Election Day", "11/1/0+1", "", -2008, 0),
    ("IN", "Lincoln's Birthday", "11/4/3+1", "", 2010, 0),
    ("KY", "Good Friday", "easter-2", "", 1900, 0),
    ("KY", "Christmas Eve", "12-24", "", 1900, 0),
    ("KY", "New Year's Eve", "12-31", "", 2013, 0),
    ("LA", "Mardi Gras", "easter-47", "", 1857, 0),
    ("LA", "Good Friday", "easter-2", "", 1900, 0),
    ("LA", "Election Day", "11/1/0+1", "", -2008, 0),
    ("MA", "Patriots' Day", "4/3/0", "", 1969, 0),
    ("MD", "American Indian Heritage Day", "11/4/3+1", "", 2008, 0),
    ("MD", "Election Day", "11/1/0+1", "", -2008, 0),
    ("ME", "Patriots' Day", "4/3/0", "", 1969, 0),
    ("MI", "Christmas Eve", "12-24", "", 2013, 0),
    ("MI", "New Year's Eve", "12-31", "", 2013, 0),
    ("MI", "Election Day", "11/1/0+1", "", -2008, 0),
    ("MO", "Lincoln's Birthday", "2-12", "near", 1971, 0),
    ("MO", "Truman Day", "5-8", "near", 1949, 0),
    ("MS", "Confederate Memorial Day", "4/-1/0", "", 1866, 0),
    ("MT", "Election Day", "11/1/0+1", "", -2008, 0),
    ("NC", "Good Friday", "easter-2", "", 1900, 0),
    ("NC", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("NC", "Christmas Eve", "12-24", "", 2013, 0),
    ("NE", "Arbor Day", "4/-1/4", "", 1989, 0),
    ("NE", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("NH", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("NH", "Election Day", "11/1/0+1", "", -2008, 0),
    ("NJ", "Good Friday", "easter-2", "", 1900, 0),
    ("NJ", "Election Day", "11/1/0+1", "", 2008, 0),
    ("NM", "Presidents' Day", "11/4/3+1", "", 2007, 0),
    ("NV", "Nevada Day", "10/-1/4", "", 2000, 0),
    ("NV", "Family Day", "11/4/3+1", "", 1987, 0),
    ("NY", "Lincoln's Birthday", "2-12", "monday", 1971, 0),
    ("NY", "Election Day", "11/1/0+1", "", 2015, 0),
    ("OK", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("PA", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("RI", "Victory Day", "8/2/0", "", 1948, 0),
    ("RI", "Election Day", "11/1/0+1", "", -2008, 0),
    ("SC", "Confederate Memorial Day", "5-10", "near", 2000, 0),
    ("SC", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("SC", "Day After Christmas", "12-26", "", 1900, 0),
    ("TN", "Good Friday", "easter-2", "", 1900, 0),
    ("TX", "Confederate Memorial Day", "1-19", "", 1931, 0),
    ("TX", "Texas Independence Day", "3-2", "", 1874, 0),
    ("TX", "San Jacinto Day", "4-21", "", 1875, 0),
    ("TX", "Emancipation Day", "6-19", "", 1980, 0),
    ("TX", "Lyndon Baines Johnson Day", "8-27", "", 1973, 0),
    ("TX", "Day After Thanksgiving", "11/4/3+1", "", 1975, 0),
    ("TX", "Christmas Eve", "12-24", "", 1981, 0),
    ("TX", "Day After Christmas", "12-26", "", 1981, 0),
    ("UT", "Pioneer Day", "7-24", "near", 1849, 0),
    ("VA", "Lee Jackson Day", "1/3/0-3", "", 2000, 2020),
    ("VA", "Election Day", "11/1/0+1", "", 2020, 0),
    ("VT", "Town Meeting Day", "3/1/1", "", 1800, 0),
    ("VT", "Bennington Battle Day", "8-16", "near", 1778, 0),
    ("WV", "West Virginia Day", "6-20", "near", 1927, 0),
    ("WV", "Lincoln's Day", "11/4/3+1", "", 1971, 0),
    ("WV", "Election Day", "11/1/0+1", "", -2008, 0),
]
