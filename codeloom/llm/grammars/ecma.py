"""ECMAScript modules and scripts, with TypeScript (flag ts) and JSX (flag jsx).

Binary operators have no precedence here, as only validity matters. ASI is the
statement end that may be supplied at a line break, a closing brace or the end.
'>+' and '>=+' are '>' and '>=' right after another '>'; '++n' and '--n' are the
operators after a line break, which can only be prefixes.
"""

GRAMMAR = r"""
Program: Item*
Item: Stmt | Import | Export | Decl
Semi: ';' | ASI

Name: NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let' | 'yield' | 'await' | 'target' | 'accessor'
    @ts | 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'is' | 'keyof' | 'infer' | 'satisfies' | 'asserts' | 'unique' | 'override' | 'public' | 'private' | 'protected' | 'global' | 'implements' | 'out' | 'require'
Word: Name | Reserved
Reserved: 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with'
ModName: Word | STR

Import: 'import' STR With? Semi | 'import' ImportWhat 'from' STR With? Semi
    @ts | 'import' 'type' ImportWhat 'from' STR With? Semi | 'import' Name '=' TypePath Semi | 'import' 'type'? Name '=' 'require' '(' STR ')' Semi
With: 'with' ObjectLit
ImportWhat: Name | Name ',' ImportSet | ImportSet
ImportSet: '*' 'as' Name | '{' ImportSpecs? '}'
ImportSpecs: ImportSpec % ',' | ImportSpec % ',' ','
ImportSpec: Name | ModName 'as' Name
    @ts | 'type' Name | 'type' ModName 'as' Name
Export: 'export' '*' 'from' STR With? Semi | 'export' '*' 'as' ModName 'from' STR With? Semi | 'export' '{' ExportSpecs? '}' Semi | 'export' '{' ExportSpecs? '}' 'from' STR With? Semi
    | 'export' Decl | 'export' VarStmt | 'export' 'default' FuncAny | 'export' 'default' ClassAny | 'export' 'default' DefaultExpr Semi
    | Decorator+ 'export' ClassDecl | Decorator+ 'export' 'default' ClassAny
    @ts | 'export' 'type' '{' ExportSpecs? '}' Semi | 'export' 'type' '{' ExportSpecs? '}' 'from' STR Semi | 'export' 'type' '*' 'from' STR Semi | 'export' 'type' '*' 'as' Name 'from' STR Semi
    @ts | 'export' '=' Expr Semi | 'export' 'as' 'namespace' Name Semi | 'export' 'default' InterfaceDecl | 'export' 'default' 'abstract' 'class' Name? ClassRest | 'export' 'import' Name '=' TypePath Semi
ExportSpecs: ExportSpec % ',' | ExportSpec % ',' ','
ExportSpec: ModName | ModName 'as' ModName
    @ts | 'type' ModName | 'type' ModName 'as' ModName
DefaultExpr: Assign

Decl: FuncDecl | ClassDecl
    @ts | InterfaceDecl | TypeAlias | EnumDecl | NamespaceDecl | 'declare' Ambient | 'abstract' 'class' Name ClassRest
@ts Ambient: FuncSig | ClassDecl | 'abstract' 'class' Name ClassRest | InterfaceDecl | TypeAlias | EnumDecl | NamespaceDecl | ('var' | 'let' | 'const') AmbientVar % ',' Semi | 'global' '{' ModItem* '}'
@ts AmbientVar: Binding TypeAnn? Init?
@ts FuncSig: 'async'? 'function' '*'? Name Sig Semi
FuncDecl: 'function' '*'? Name Sig Block | 'async' 'function' '*'? Name Sig Block
    @ts | FuncSig
FuncAny: FuncDecl | 'function' '*'? Sig Block | 'async' 'function' '*'? Sig Block
    @ts | 'function' Sig Semi
Sig: TypeParams? '(' Params? ')' RetAnn?
@!ts TypeParams: NEVER
@!ts RetAnn: NEVER
@!ts TypeAnn: NEVER
@!ts TypeArgs: NEVER
@ts RetAnn: ':' RetType
@ts RetType: Type | Predicate
@ts TypeAnn: ':' Type
Params: Param % ',' | Param % ',' ',' | Rest | Param % ',' ',' Rest | Rest ','
Rest: Decorator* '...' Binding TypeAnn?
@!ts Param: Decorator* Binding Init?
@ts Param: Decorator* ParamMods Binding '?'? TypeAnn? Init? | 'this' TypeAnn
@ts ParamMods: | ParamMods Modifier
@ts Modifier: 'public' | 'private' | 'protected' | 'readonly' | 'override'
Init: '=' Assign
Binding: Name | ObjectPat | ArrayPat
ObjectPat: '{' '}' | '{' PatProps '}'
PatProps: PatProp % ',' | PatProp % ',' ',' | PatProp % ',' ',' '...' Binding | '...' Binding
PatProp: Name Init? | PropName ':' Binding Init?
ArrayPat: '[' PatElems ']'
PatElems: PatElem % ','
PatElem: | Binding Init? | '...' Binding

ClassDecl: Decorator* 'class' Name ClassRest
ClassAny: Decorator* 'class' Name? ClassRest
ClassRest: TypeParams? Heritage? '{' Member* '}'
Heritage: 'extends' Left TypeArgs?
    @ts | 'implements' TypeRef % ',' | 'extends' Left TypeArgs? 'implements' TypeRef % ','
Decorator: '@' Left
Member: ';' | Decorator* Mods Method | Decorator* Mods Field Semi | 'static' Block
    @ts | Decorator* Mods PropName '?'? Sig Semi | Decorator* Mods Index Semi
Mods: | Mods Mod
Mod: 'static' | 'accessor'
    @ts | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'
Method: PropName Sig Block | '*' PropName Sig Block | 'async' PropName Sig Block | 'async' '*' PropName Sig Block | 'get' PropName '(' ')' RetAnn? Block | 'set' PropName '(' Param ')' RetAnn? Block
    @ts | PropName '?' Sig Block | 'get' PropName '(' ')' RetAnn? Semi | 'set' PropName '(' Param ')' Semi
Field: PropName TypeAnn? Init?
    @ts | PropName ('?' | '!') TypeAnn? Init?
PropName: Word | STR | NUM | '[' Assign ']' | PRIVATE

VarStmt: 'var' VarDecl % ',' Semi | 'let' VarDecl % ',' Semi | 'const' ConstDecl % ',' Semi
    @ts | 'const' 'enum' Name EnumBody
VarDecl: Name TypeAnn? | Name TypeAnn? Init | ObjectPat TypeAnn? Init | ArrayPat TypeAnn? Init
    @ts | Name '!' TypeAnn
ConstDecl: Binding TypeAnn? Init

Block: '{' Stmts '}'
Stmts: | Stmts Inner
Inner: Stmt | Decl
    @ts | Import
Stmt: Block | VarStmt | ';' | ExprStmt | If | Loop | 'continue' Name? Semi | 'break' Name? Semi | 'return' Expr? Semi | 'throw' Expr Semi | 'debugger' Semi
    | 'with' '(' Expr ')' Stmt | Name ':' Body | Switch | Try
Body: Stmt | FuncDecl
ExprStmt: Expr Semi
If: 'if' '(' Expr ')' Body | 'if' '(' Expr ')' Body 'else' Body
Loop: 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'do' Stmt 'while' '(' Expr ')' | 'for' '(' ForInit? ';' Expr? ';' Expr? ')' Stmt
    | 'for' 'await'? '(' ForHead ('in' | 'of') Expr ')' Stmt
ForInit: Expr | ('var' | 'let' | 'const') ForVar % ','
ForVar: Binding TypeAnn? Init?
ForHead: ('var' | 'let' | 'const') Binding TypeAnn? | Left
Switch: 'switch' '(' Expr ')' '{' Case* '}'
Case: 'case' Expr ':' Stmts | 'default' ':' Stmts
Try: 'try' Block Catch | 'try' Block Catch? 'finally' Block
Catch: 'catch' Block | 'catch' '(' Binding TypeAnn? ')' Block

Expr: Assign | Expr ',' Assign
Assign: Cond | Arrow | Left AssignOp Assign | 'yield' | 'yield' Assign | 'yield' '*' Assign
    @ts | Left '!' AssignOp Assign
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=+' | '>' '>+' '>=+' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
Arrow: Name '=>' ArrowBody | 'async' Name '=>' ArrowBody | TypeParams? '(' Params? ')' RetAnn? '=>' ArrowBody | 'async' TypeParams? '(' Params? ')' RetAnn? '=>' ArrowBody
ArrowBody: Assign | Block
Cond: Binary | Binary '?' Assign ':' Assign
Binary: Unary | Binary BinOp Unary | PRIVATE 'in' Unary
    @ts | Binary 'as' AsType | Binary 'satisfies' Type
@ts AsType: Type | 'const'
BinOp: '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>' '>+' | '>' '>+' '>+' | '+' | '-' | '*' | '/' | '%' | '**'
Unary: Postfix | UnOp Unary | ('++' | '--' | '++n' | '--n') Unary
    @cast | '<' Type '>' Unary | '<' 'const' '>' Unary
UnOp: 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await'
Postfix: Left | Left '++' | Left '--'
Left: Primary | Left '.' Dotted | Left '?.' Dotted | Left '[' Expr ']' | Left '?.' '[' Expr ']' | Left Args | Left '?.' Args | Left Template | 'new' NewTarget | 'new' '.' 'target' | 'import' Args | 'import' '.' Word | 'super' Args | 'super' '.' Dotted | 'super' '[' Expr ']'
    @ts | Left '!' | Left TypeArgs Args | Left '?.' TypeArgs Args | Left TypeArgs Template | Left TypeArgs
NewTarget: NewHead | NewHead Args
    @ts | NewHead TypeArgs Args | NewHead TypeArgs
NewHead: Primary | NewHead '.' Dotted | NewHead '[' Expr ']' | 'new' NewTarget | 'super' '.' Dotted
Dotted: Word | PRIVATE
Args: '(' ')' | '(' ArgList ')' | '(' ArgList ',' ')'
ArgList: Arg % ','
Arg: Assign | '...' Assign
Primary: 'this' | Name | NUM | STR | REGEX | 'null' | 'true' | 'false' | Template | '[' Elements ']' | ObjectLit | FuncExpr | ClassExpr | '(' Expr ')'
    @jsx | Jsx
FuncExpr: 'function' '*'? Name? Sig Block | 'async' 'function' '*'? Name? Sig Block
ClassExpr: Decorator* 'class' Name? ClassRest
Elements: Element % ','
Element: | Assign | '...' Assign
ObjectLit: '{' '}' | '{' Prop % ',' '}' | '{' Prop % ',' ',' '}'
Prop: Name | Name Init | PropName ':' Assign | '...' Assign | Method
Template: TPL | TPLHEAD Expr TplRest
TplRest: TPLTAIL | TPLMID Expr TplRest

@jsx Jsx: '<J' JsxTag JsxAttr* '/>J' | '<J' JsxTag JsxAttr* '>J' JsxChild* '</J' JsxTag '>J' | '<J' '>J' JsxChild* '</J' '>J'
@jsx JsxTag: JNAME JsxDot* | JNAME ':' JNAME
@jsx    | JNAME JsxDot* JsxTypeArgs
@jsx JsxDot: '.' JNAME
@jsx JsxTypeArgs: NEVER
@jsx JsxAttr: JNAME | JNAME '=' JsxValue | JNAME ':' JNAME '=' JsxValue | '{' '...' Assign '}'
@jsx JsxValue: JSTR | '{' Assign '}' | Jsx
@jsx JsxChild: JSXTEXT | Jsx | '{' '}' | '{' Expr '}' | '{' '...' Assign '}'

@ts InterfaceDecl: 'interface' Name TypeParams? '{' TypeMembers '}' | 'interface' Name TypeParams? 'extends' TypeRef % ',' '{' TypeMembers '}'
@ts TypeAlias: 'type' Name TypeParams? '=' Type Semi
@ts EnumDecl: 'enum' Name EnumBody | 'const' 'enum' Name EnumBody
@ts EnumBody: '{' '}' | '{' EnumItem % ',' '}' | '{' EnumItem % ',' ',' '}'
@ts EnumItem: PropName | PropName Init
@ts NamespaceDecl: ('namespace' | 'module') Name % '.' '{' ModItem* '}' | 'module' STR '{' ModItem* '}' | 'module' STR Semi
@ts ModItem: Item | 'export'? 'const' NoInit % ',' Semi
@ts NoInit: Binding TypeAnn
@ts TypeParams: '<' TypeParam % ',' '>' | '<' TypeParam % ',' ',' '>'
@ts TypeParam: ParamMod* Name | ParamMod* Name 'extends' Type | ParamMod* Name '=' Type | ParamMod* Name 'extends' Type '=' Type
@ts ParamMod: 'const' | 'in' | 'out'
@ts TypeArgs: '<' Type % ',' Close | '<<' TypeParams2 
@ts TypeParams2: NEVER
@ts Close: '>' | '>+'
@ts Type: Union | Union 'extends' Union '?' Type ':' Type | FnType
@ts FnType: TypeParams? '(' Params? ')' '=>' RetType | 'new' TypeParams? '(' Params? ')' '=>' Type | 'abstract' 'new' TypeParams? '(' Params? ')' '=>' Type
@ts Predicate: Name 'is' Type | 'this' 'is' Type | 'asserts' Name | 'asserts' 'this' | 'asserts' Name 'is' Type
@ts Union: TypeUn | ('|' | '&') TypeUn | Union ('|' | '&') TypeUn
@ts TypeUn: TypePost | 'keyof' TypeUn | 'unique' TypeUn | 'readonly' TypeUn | 'infer' Name | 'infer' Name 'extends' TypePost
@ts TypePost: TypePrim | TypePost '[' ']' | TypePost '[' Type ']'
@ts TypePrim: TypeRef | 'this' | 'void' | 'null' | 'true' | 'false' | STR | NUM | '-' NUM | TypeTpl | '{' TypeMembers '}' | Mapped | '[' ']' | '[' TupleItem % ',' ']' | '[' TupleItem % ',' ',' ']' | '(' Type ')'
    | 'typeof' TypePath TypeArgs? | 'typeof' 'import' '(' STR ')' | 'import' '(' STR ')' | 'import' '(' STR ')' '.' TypePath TypeArgs?
@ts TypeTpl: TPL | TPLHEAD Type TypeTplRest
@ts TypeTplRest: TPLTAIL | TPLMID Type TypeTplRest
@ts TypeRef: TypePath | TypePath TypeArgs
@ts TypePath: Name | TypePath '.' Word | 'this' '.' Word
@ts TupleItem: Type | Type '?' | '...' Type | Word ':' Type | Word '?' ':' Type | '...' Word ':' Type
@ts Mapped: '{' MapSign? '[' Name 'in' Type ('as' Type)? ']' MapOpt? TypeAnn? Semi? '}' | '{' MapSign? '[' Name 'in' Type ('as' Type)? ']' MapOpt? TypeAnn? ',' '}'
@ts MapSign: 'readonly' | ('+' | '-') 'readonly'
@ts MapOpt: '?' | ('+' | '-') '?'
@ts TypeMembers: | TypeMember | TypeMember MemberEnd TypeMembers
@ts MemberEnd: ';' | ',' | ASI
@ts TypeMember: TypeParams? '(' Params? ')' RetAnn? | 'new' TypeParams? '(' Params? ')' RetAnn? | Index | 'readonly'? PropName '?'? TypeAnn? | PropName '?'? Sig | 'get' PropName '(' ')' RetAnn? | 'set' PropName '(' Param ')' RetAnn?
@ts Index: ModPre* '[' Name ':' Type ']' TypeAnn
@ts ModPre: 'readonly'
"""
